"""DuckDB statements for the registered queries that SQL can express."""

#: CRC-32 of a text's bytes, half a byte at a time: the table of the polynomial 0xEDB88320 (fixed values).
CRC = """
        CAST(xor(list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(range(2 * octet_length(encode(f))), lambda i: (instr('0123456789ABCDEF', hex(f)[i + 2 - 2 * (i % 2)]) - 1)::UBIGINT)),
            lambda c, x: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, x) & 15)::INT]::UBIGINT)), 4294967295::UBIGINT) AS BIGINT)
"""

#: Runs of 1 to 3 words of every text, repeats counted, as (id, f).
FEATURES = """
        SELECT id, unnest(list_concat(w,
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
        FROM {words}
"""

WORDS = r"""
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
"""

SQL = {
    "op11_importance_resampling": f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w FROM documents),
        goal AS MATERIALIZED (SELECT 0 AS id, {WORDS} AS w FROM benchmark),
        found AS MATERIALIZED (
            SELECT true AS of_docs, * FROM ({FEATURES.format(words="docs")})
            UNION ALL SELECT false, * FROM ({FEATURES.format(words="goal")})),
        hashed AS MATERIALIZED (SELECT f, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM found)),
        counted AS (SELECT bucket, count(*) FILTER (of_docs) AS s, count(*) FILTER (NOT of_docs) AS t FROM found JOIN hashed USING (f) GROUP BY bucket),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain
            FROM counted),
        weighed AS (
            SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
            FROM found JOIN hashed USING (f) JOIN gain USING (bucket) WHERE of_docs GROUP BY id),
        scored AS (
            SELECT id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                CAST(('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8)) AS BIGINT) AS h
            FROM docs LEFT JOIN weighed USING (id)),
        noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
        fit AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS rank, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
        FROM noisy LEFT JOIN fit USING (id)
    """,
    "op13_hard_negatives": """
        WITH taken AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        pairs AS (
            SELECT a.r AS anchor_row, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
                CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM taken a JOIN taken b ON a.r <> b.r AND len(a.v) = len(b.v)
            WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT * FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id NULLS LAST) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
            CAST(row_number() OVER (PARTITION BY p.anchor_row, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN pairs n ON n.anchor_row = p.anchor_row AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_row, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST) <= 5
    """,
}
