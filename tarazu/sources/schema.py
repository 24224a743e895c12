"""The one record schema of translated, native and synthetic data."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ("source", "revision", "license", "split", "origin", "state_lang", "question_lang", "state", "question_type", "question_text")
OPTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
RECORD = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("source_id", T.StringType(), False), *[T.StructField(c, T.StringType()) for c in _TEXT],
    T.StructField("options", T.ArrayType(OPTION)), T.StructField("gold", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("flags", T.StructType([T.StructField(c, T.BooleanType()) for c in ("auto_ok", "meaning_flag", "reviewed")])),
])
COLUMNS = RECORD.names
#: The domains of the coded fields.
ORIGINS = ("translated", "native", "synthetic")
QUESTION_TYPES = ("choice", "score", "noul")
SPLITS = ("train", "validation", "calibration", "test")
