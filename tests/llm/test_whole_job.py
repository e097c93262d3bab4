"""The training-data operators do the whole job: cases that a cut or a collapsed count would lose."""

import numpy as np
import pytest

from webloom.llm import language, secrets


@pytest.mark.parametrize("start", ["", "<!-- " + "x" * 50_000 + " -->", " " * 50_000, '<!-- <html lang="en"> -->'])
def test_language_is_declared_after_a_long_start(spark, start):
    pages = spark.createDataFrame([(1, "http://a.org/", f'{start}<html lang="fr"><p>x</p>')], "id long, url string, html string")
    assert language._evidence(pages, ["fr"], np.zeros((1, language.BUCKETS))).first()["declared"] == "fr"


@pytest.mark.parametrize("before", ["sample_auth=", "path/to/example/", "dummy=xxxx/"])
def test_secret_joined_to_a_placeholder(before):
    text = f"{before}Zq8vT1rK0pLx7WnB3yHd9sQe."
    assert [(k, text[a:b]) for k, a, b in secrets.scan_text(text)[1]] == [("entropy", "Zq8vT1rK0pLx7WnB3yHd9sQe")]
    assert not secrets.scan_text("sample_auth=example_Zq8vT1rK0pLx7WnB3yHd9sQe")[1]
