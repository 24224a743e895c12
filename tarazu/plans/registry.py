"""Queries and the DuckDB SQL each is held against, side by side; derived inputs in SQL that both engines read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Derived inputs. H32(x) stands for the number of a text's first 8 MD5 digits, which the engines spell differently.
FIXTURES: dict[str, str] = {
    # two yes/no decisions for each labelled document
    "fx_docs": """SELECT d.doc_id, concat(cast(d.doc_id AS string), '-', q.task) AS id, cast(d.doc_id AS string) AS source_id, d.source, d.lang, d.text, q.task,
        CASE WHEN (q.task = 'quality' AND l.quality = 1) OR (q.task = 'toxic' AND l.toxic = 1) THEN 'yes' ELSE 'no' END AS label,
        cast(substr(d.source, 4) AS int) % 5 AS sn, CASE WHEN cast(substr(d.source, 4) AS int) % 3 = 0 THEN 'native' WHEN cast(substr(d.source, 4) AS int) % 3 = 1 THEN 'translated' ELSE 'synthetic' END AS origin,
        d.doc_id * 2 + CASE WHEN q.task = 'toxic' THEN 1 ELSE 0 END AS k,
        CASE WHEN H32(concat('0:', cast(d.doc_id AS string))) % 100 < 80 THEN 'train' WHEN H32(concat('0:', cast(d.doc_id AS string))) % 100 < 88 THEN 'validation' WHEN H32(concat('0:', cast(d.doc_id AS string))) % 100 < 92 THEN 'calibration' ELSE 'test' END AS split
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 'quality' AS task UNION ALL SELECT 'toxic' AS task) q""",
    # four runs' scores of both options
    "fx_long": """SELECT r.run, f.id, f.doc_id, f.task, f.lang, f.origin, f.split, o.idx, CASE WHEN o.idx = 0 THEN 'yes' ELSE 'no' END AS option_id,
        CASE WHEN (f.label = 'yes') = (o.idx = 0) THEN cast(1 AS double) ELSE cast(0 AS double) END AS g,
        cast((f.k * 7919 + o.idx * 104729 + r.run * 1299709) % 1000 AS double) / 250 - 2 + CASE WHEN (f.label = 'yes') = (o.idx = 0) THEN cast(r.run AS double) / 2 ELSE cast(0 AS double) END AS score
        FROM fx_docs f CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 AS idx) o CROSS JOIN (SELECT 0 AS run UNION ALL SELECT 1 AS run UNION ALL SELECT 2 AS run UNION ALL SELECT 3 AS run) r""",
    # each decision asked in English and in Persian, where the scores are off by a hash
    "fx_asked": """SELECT l.run, l.id, l.task, q.asked, l.idx, l.option_id, l.g, CASE WHEN q.asked = 'fa' THEN l.score + cast(H32(concat(cast(l.run AS string), ':', l.id, ':', cast(l.idx AS string))) % 1000 AS double) / 400 ELSE l.score END AS score
        FROM fx_long l CROSS JOIN (SELECT 'en' AS asked UNION ALL SELECT 'fa' AS asked) q""",
    "fx_p": """SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY run, id) AS p FROM fx_long""",
    # the same with run 3 as a teacher whose probabilities are the gold
    "fx_soft": """SELECT a.run, a.id, a.task, a.lang, a.idx, a.option_id, a.p, t.p AS g FROM fx_p a JOIN fx_p t ON a.id = t.id AND a.idx = t.idx AND t.run = 3 WHERE a.run < 3""",
    "fx_top": """SELECT x.run, x.id, x.doc_id, x.task, x.lang, x.origin, x.split, CASE WHEN x.p >= y.p THEN 'yes' ELSE 'no' END AS pred, greatest(x.p, y.p) AS conf, CASE WHEN x.g >= y.g THEN 'yes' ELSE 'no' END AS gold,
        (x.p >= y.p) = (x.g >= y.g) AS correct FROM fx_p x JOIN fx_p y ON x.run = y.run AND x.id = y.id AND x.idx = 0 AND y.idx = 1""",
    # scores 1 to 5 by an event's value, and a prediction that is off by a hash
    "fx_score": """SELECT event_id AS id, user_id, event_type, cast(1 + least(4, floor(value / 10)) AS bigint) AS gold, least(5, greatest(1, cast(1 + least(4, floor(value / 10)) AS bigint) + H32(cast(event_id AS string)) % 5 - 2)) AS pred FROM events""",
    # a translation of each document, damaged by doc_id modulo 13
    "fx_pairs": """SELECT cast(doc_id AS string) AS source_id, 'state' AS field, text AS source_text,
        CASE WHEN doc_id % 13 = 1 THEN translate(text, '0123456789', '۰۱۲۳۴۵۶۷۸۹') WHEN doc_id % 13 = 2 THEN regexp_replace(text, '[0-9]', 'x') WHEN doc_id % 13 = 3 THEN ''
        WHEN doc_id % 13 = 4 THEN 'again and again and again and again and again and again' WHEN doc_id % 13 = 5 THEN substr(text, 1, 40) ELSE text END AS target_text, 'translate' AS rule FROM documents
        UNION ALL SELECT cast(doc_id AS string), 'source', source, CASE WHEN doc_id % 13 = 6 THEN upper(source) ELSE source END, 'keep' FROM documents""",
    # benchmark items, and every twentieth document with words added, as a test side
    "fx_tests": """SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1 - doc_id AS id, concat(text, ' and so on') AS text FROM documents WHERE doc_id % 20 = 0""",
    "fx_verdicts": """SELECT cast(doc_id AS string) AS source_id, k.kind AS flag_kind, H32(concat(k.kind, cast(doc_id AS string))) % 20 = 0 AS flagged FROM documents
        CROSS JOIN (SELECT 'meaning' AS kind UNION ALL SELECT 'urgency' AS kind UNION ALL SELECT 'negation' AS kind UNION ALL SELECT 'actor' AS kind) k""",
    "fx_flags": """SELECT source_id, max(CASE WHEN flagged THEN 1 ELSE 0 END) = 1 AS flagged FROM fx_verdicts GROUP BY source_id""",
    "fx_reviews": """SELECT cast(doc_id AS string) AS source_id, CASE WHEN H32(concat('r', cast(doc_id AS string))) % 10 < 7 THEN 'ok' WHEN H32(concat('r', cast(doc_id AS string))) % 10 < 9 THEN 'fix' ELSE 'drop' END AS outcome, concat('fixed ', cast(doc_id AS string)) AS fix_text FROM documents""",
    # training curves: a run per source, its steps the documents in order
    "fx_curve": """SELECT source AS run_id, 'loss' AS metric, doc_id AS step, CASE WHEN doc_id % 97 = 5 THEN cast('nan' AS double) ELSE cast(5 AS double) / (1 + doc_id % 50) + cast(n_chars % 100 AS double) / 200 END AS value FROM documents
        UNION ALL SELECT source, 'runtime', 0, cast(sum(n_chars) AS double) FROM documents GROUP BY source""",
    "fx_events": """SELECT user_id % 20 AS run_id, event_id, ts, event_type, value FROM events""",
    "fx_templates": """SELECT event_type AS task, concat(event_type, '-', cast(user_id % 8 AS string)) AS template_id, concat(chr(123), 'who', chr(125), ' did ', chr(123), 'what', chr(125), ' ', cast(user_id % 8 AS string)) AS pattern FROM events GROUP BY event_type, user_id % 8""",
}


def _names(text: str) -> list[str]:
    known = "|".join([*TABLES, *FIXTURES])
    return list(dict.fromkeys(re.findall(rf"\b(?:FROM|JOIN)\s+({known})\b", text)))


def _spelled(text: str, h32: str) -> str:
    """The text with each H32(…) replaced; the argument may hold parentheses."""
    while (at := text.find("H32(")) >= 0:
        depth, end = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + h32.format(text[at + 4 : end - 1]) + text[end:]
    return text


class Data:
    """The tables of a folder and the derived inputs, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        known = _names(text)
        named = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(known)})\b", r"\1\2{\3}", text) if known else text
        return self.spark.sql(_spelled(named, "cast(conv(substr(md5({}), 1, 8), 16, 10) AS bigint)"), **{n: getattr(self, n) for n in known})


def duck(body: str) -> str:
    """body for DuckDB, with the derived inputs that it needs put before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in FIXTURES and n not in order:
                need(FIXTURES[n])
                order.append(n)

    need(body)
    ctes = [f"{n} AS ({FIXTURES[n].replace(chr(39) + '[0-9]' + chr(39) + ', ' + chr(39) + 'x' + chr(39), chr(39) + '[0-9]' + chr(39) + ', ' + chr(39) + 'x' + chr(39) + ', ' + chr(39) + 'g' + chr(39))})" for n in order]
    body = body.strip()
    if ctes:
        start = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
        body = f"{start}{', '.join(ctes)}, {body[len(start):]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(ctes)} {body}"
    return _spelled(body, "cast('0x' || substr(md5({}), 1, 8) AS bigint)")


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, decimals and floats as double: types that the engines share."""
    wide = {T.IntegerType: "long", T.ShortType: "long", T.ByteType: "long", T.FloatType: "double"}
    return df.select(*[F.col(f"`{f.name}`").cast(wide.get(type(f.dataType), "double" if isinstance(f.dataType, T.DecimalType) else f.dataType)).alias(f.name) for f in df.schema])


def query(sql: str | None = None, name: str | None = None):
    """Registers f(data) -> DataFrame as a query, and its DuckDB SQL."""

    def add(f: Callable[[Data], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: plain(f(Data(spark, sf_dir)))
        if sql:
            ORACLES[key] = duck(sql)
        return f

    return add
