"""DuckDB SQL for the queries that SQL can express. The others are held against brute force in tests/llm:
keyed Feistel permutations, learned models, tokenizer ids, approximate search and XXH64 have no SQL form."""

from __future__ import annotations

from tarazu.llm.chat import BODY, CONTROL, END, TURN
from tarazu.llm.mixing import SCHEDULES, WEIGHTS
from tarazu.llm.repetition import MAX_LINES, MAX_NGRAM

_WORD = r"[^\x20\x09-\x0D]+"


def _mix() -> str:
    weight = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
    # each default schedule is one straight piece from w0 to w1 with mean 1: area a x^2 + b x
    a = "[" + ", ".join(f"{(k[1][1] - k[0][1]) / 2}::DOUBLE" for k in SCHEDULES) + "]"
    b = "[" + ", ".join(f"{k[0][1]}::DOUBLE" for k in SCHEDULES) + "]"
    share = "least((cum + {k} * source_size + ({length}) / 2.0::DOUBLE) / greatest(floor(target + 0.5), 1), 1.0::DOUBLE)"
    place = "round(2 * {s} / (" + b + "[kind] + sqrt(greatest(" + b + "[kind] * " + b + "[kind] + 4 * " + a + "[kind] * {s}, 0))), 9)"
    first, second = (place.format(s=share.format(k=k, length=f"CASE WHEN {k} < passes THEN size ELSE extra END")) for k in (0, 1))
    return f"""WITH d AS (SELECT doc_id, source, md5(concat('0:', coalesce(cast(doc_id AS varchar), 'null'), ':', md5(coalesce(text, '')))) AS h, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS kind FROM d GROUP BY source),
    c AS (SELECT *, {weight}[kind] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
    j AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS j FROM c),
    r AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate FROM j WINDOW b AS (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, kind, coalesce(least(cap, w * (SELECT arg_min(rate, j) FROM r WHERE rate * w <= cap)), cap) AS target FROM r),
    x AS (SELECT d.doc_id, d.size, t.source_size, t.kind, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum,
        CASE WHEN t.source_size = 0 THEN 0 WHEN t.target >= 2 * t.source_size THEN 2 WHEN t.target >= t.source_size THEN 1 ELSE 0 END AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    y AS (SELECT *, greatest(0, least(size, cast(floor(target + 0.5) AS bigint) - passes * source_size - cum)) AS extra FROM x),
    z AS (SELECT *, passes * size + extra AS taken, CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END END AS copies FROM y)
    SELECT doc_id, size, source_size, round(target, 6) AS target, taken, CASE WHEN copies > 0 THEN {first} END AS first_position, CASE WHEN copies > 1 THEN {second} END AS second_position FROM z"""


def _repetition() -> str:
    parts, joins, cols = [], [], []
    for n in (3, *MAX_NGRAM):
        gram = f"string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        hit = f"SELECT doc_id, w, i, i <= n - {n - 1} AND count(*) OVER (PARTITION BY doc_id, i <= n - {n - 1}, g) > 1 AS hit FROM (SELECT doc_id, w, i, n, {gram} AS g FROM t)"
        covered = f"SELECT doc_id, w, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM ({hit})"
        parts.append(f"c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w))::BIGINT AS chars FROM ({covered}) WHERE c GROUP BY doc_id)")
        joins.append(f"LEFT JOIN c{n} ON d.doc_id = c{n}.doc_id")
        cols.append("coalesce(c3.words, 0) AS n_repeat_words" if n == 3 else f"coalesce(c{n}.chars, 0) AS dup_{n}gram_chars")
    over = " OR ".join(f"dup_{n}gram_chars > {x}::DOUBLE * word_chars" for n, x in MAX_NGRAM.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
    l AS (SELECT doc_id, line, count(*) AS times, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id, line),
    s AS (SELECT doc_id, sum(times - 1)::BIGINT AS dups, sum(CASE WHEN times > 1 THEN times * chars ELSE 0 END)::BIGINT AS chars FROM l GROUP BY doc_id), {", ".join(parts)},
    m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(s.dups, 0) AS n_dup_lines, {", ".join(cols)}, coalesce(s.chars, 0) AS dup_line_chars FROM d LEFT JOIN s ON d.doc_id = s.doc_id {" ".join(joins)})
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR dup_line_chars > {MAX_LINES}::DOUBLE * word_chars OR {over}) AS kept FROM m"""


_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1) for i in range(32)], '')"

_LINES = """WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
    h AS (SELECT source, line, count(*) AS n FROM (SELECT doc_id, source, unnest(list_distinct([trim(x) for x in ls])) AS line FROM d) WHERE line <> '' GROUP BY 1, 2),
    b AS (SELECT h.source, list(h.line) AS bad FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.1::DOUBLE * pages GROUP BY 1),
    k AS (SELECT d.*, CASE WHEN b.bad IS NULL THEN ls ELSE [x for x in ls if trim(x) = '' OR NOT list_contains(b.bad, trim(x))] END AS left_over FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, source, array_to_string(left_over, chr(10)) AS text, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(left_over), 0) AS n_dropped FROM k"""


def _chat() -> str:
    import re

    control = "|".join(re.escape(c) for c in CONTROL)
    escaped = "(length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + control + "')))"
    marks = len(TURN) + len(BODY) + len(END)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), t, chr(10)), '' ORDER BY turn, role, t)) AS turns_sha256, coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256, sum({marks} + {escaped.format('role')} + {escaped.format('t')})::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


def _merkle() -> str:
    field = "coalesce(concat(strlen({0}::VARCHAR), ':', {0}::VARCHAR), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    step = "list_reduce(list_concat([xor(c, b)], [0::BIGINT for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT for x in string_split(coalesce(doc_id::VARCHAR, ''), '') if x <> '']), lambda c, b: {step}), 4294967295)"
    tampered = "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END"
    # one tree a source, then one over their roots; h is a node, p its place, n the nodes of its level
    up = """SELECT tree, level + 1 AS level, p // 3 AS p, (any_value(n) + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {0} WHERE n > 1 GROUP BY tree, level, p // 3"""
    climb = lambda nodes, walk: f"""SELECT w.r, w.tree, w.level + 1 AS level, w.p // 3 AS p, (w.n + 2) // 3 AS n, concat(w.proof, s.l, s.q) AS proof, sha256(concat(s.l, w.f, s.q)) AS f
        FROM {walk} w JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.p = w.p WHERE w.n > 1"""  # noqa: E731
    around = "SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, p // 3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, p // 3 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS q FROM {0}"
    return f"""WITH RECURSIVE e AS (SELECT *, ({crc}) % 2 = 0 AS even FROM documents),
    d AS (SELECT doc_id, {leaf("text")} AS leaf, {leaf("tampered")} AS f, coalesce('=' || source, '-') AS tree FROM (SELECT *, {tampered} AS tampered FROM e)),
    k AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM d),
    t AS (SELECT tree, 0::BIGINT AS level, p, n, leaf AS h FROM k UNION ALL {up.format("t")}),
    ts AS ({around.format("t")}),
    w AS (SELECT r, tree, 0::BIGINT AS level, p, n, '' AS proof, f FROM k UNION ALL {climb("ts", "w")}),
    s AS (SELECT tree, h FROM t WHERE n = 1),
    sk AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM s),
    u AS (SELECT tree, 0::BIGINT AS level, p, n, h FROM sk UNION ALL {up.format("u")}),
    us AS ({around.format("u")}),
    v AS (SELECT w.r, '' AS tree, 0::BIGINT AS level, sk.p, sk.n, w.proof, w.f FROM w JOIN sk ON w.tree = sk.name WHERE w.n = 1 UNION ALL {climb("us", "v")})
    SELECT k.doc_id, k.leaf, s.h AS subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = u.h AS verified
    FROM k JOIN s ON k.tree = s.tree JOIN v ON k.r = v.r AND v.n = 1 JOIN u ON u.n = 1"""


ORACLES: dict[str, str] = {
    "op2_curriculum_mix": _mix(),
    "op5_repetition_coverage": _repetition(),
    "op6_warc_bundles": f"""SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)""",
    "op8_line_dedup": _LINES,
    "op10_chat_format": _chat(),
    "op13_merkle_manifest": _merkle(),
}
