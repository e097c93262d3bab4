"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType(), "v": T.ArrayType(T.DoubleType()), "m": T.MapType(T.StringType(), T.StringType())}


def _table(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split(":") for f in fields.split())])


TABLES = {
    "land": _table("id:l name:s description:s lang:s created_at:t"),
    "domain": _table("id:l name:s http_status:s title:s description:s keywords:s created_at:t fetched_at:t"),
    "expression": _table(
        "id:l land_id:l url:s domain:s http_status:s lang:s title:s description:s keywords:s readable:s html:s created_at:t published_at:t fetched_at:t approved_at:t readable_at:t relevance:i depth:i validllm:s validmodel:s seorank:s"
    ),
    "expressionlink": _table("source_id:l target_id:l"),
    "word": _table("land_id:l term:s lemma:s"),
    "media": _table("expression_id:l url:s type:s width:i height:i file_size:l format:s color_mode:s has_transparency:b aspect_ratio:d exif_data:m image_hash:s websafe_colors:m analyzed_at:t analysis_error:s"),
    "paragraph": _table("id:l expression_id:l domain:s para_index:i text:s text_hash:s created_at:t"),
    "paragraph_embedding": _table("text_hash:s embedding:v norm:d model_name:s created_at:t"),
    "paragraph_similarity": _table("source_paragraph:l target_paragraph:l score:d score_raw:d method:s created_at:t"),
    "tag": _table("id:l land_id:l parent_id:l name:s sorting:i color:s"),
    "taggedcontent": _table("tag_id:l expression_id:l text:s from_char:i to_char:i"),
}
