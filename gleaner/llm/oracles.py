"""DuckDB SQL for the queries that SQL can express; each is written from the definition, not from the operator's plan."""

from __future__ import annotations

from gleaner.llm import language, licences, mixing

_COMPONENTS = """
    reach(id, other) AS (
        SELECT id, id FROM nodes
        UNION
        SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
    ),
    classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id)"""

NEAR_DEDUP = f"""
    WITH RECURSIVE
    words AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    shingles AS (
        SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM words WHERE len(w) > 0
    ),
    counted AS (SELECT doc_id, s, count(*) AS n FROM shingles GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(n) AS size FROM counted GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS met FROM counted a JOIN counted b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE met >= 0.8 * (x.size + y.size - met)
        UNION ALL
        SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON x.text = y.text AND x.doc_id <> y.doc_id WHERE len(x.w) = 0
    ),
    nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
    SELECT id AS doc_id, class_id, id = class_id AS kept FROM classes"""

VECTOR_DEDUP = f"""
    WITH RECURSIVE
    known AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM known a JOIN known b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
    nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
    degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, class_id AS component_id, id = class_id AS kept FROM classes LEFT JOIN degrees ON a = id"""

TOPK = """
    WITH known AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM known a JOIN known b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

WARC = """
    WITH page AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    firsts AS (SELECT payload_digest, min(page_id) AS first FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
    FROM page p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100"""

MIXING = f"""
    WITH counts AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
    sums AS (SELECT sum(n) AS all_n, sum(n ** {mixing.TEMPER}) AS all_w FROM counts),
    rates AS (SELECT s, n ** {mixing.TEMPER} * (all_n / all_w) / n AS rate FROM counts, sums),
    cdf AS (
        SELECT s, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY s ORDER BY j) AS p
        FROM rates, (SELECT unnest(range(0, 200)) AS j)
    ),
    drawn AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
    copies AS (
        SELECT doc_id, text, lang, source, n_chars, u, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(source, '') AND p <= u) AS n FROM drawn
    )
    SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM copies"""


_CRC32 = """xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, 4294967295::BIGINT))"""

LANGUAGE = f"""
    WITH folded AS (SELECT doc_id, text, lang, {_CRC32} % 4 AS fold FROM documents),
    cleaned AS (SELECT *, string_split(regexp_replace(' ' || regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g') || ' ', ' +', ' ', 'g'), '') AS a FROM folded),
    chosen AS (
        SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS n FROM folded WHERE lang IS NOT NULL AND text IS NOT NULL AND fold <> 2)
        WHERE n <= {language.TRAIN_ROWS}
    ),
    letters AS (SELECT doc_id, unnest(a) AS x, unnest(a[2:]) AS y, unnest(a[3:]) AS z FROM cleaned WHERE len(a) > 1),
    grams AS (
        SELECT doc_id, x AS g FROM letters WHERE x <> ' ' UNION ALL SELECT doc_id, x || y FROM letters WHERE y IS NOT NULL UNION ALL SELECT doc_id, x || y || z FROM letters WHERE z IS NOT NULL
    ),
    counted AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL),
    own AS (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS i FROM counted) WHERE i < {language.PROFILE}),
    learned AS (SELECT lang, g, sum(n) AS n FROM counted JOIN chosen USING (doc_id) JOIN folded USING (doc_id) GROUP BY lang, g),
    profile AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r FROM learned) WHERE r < {language.PROFILE}),
    distances AS (
        SELECT o.doc_id, l.lang, sum(coalesce(abs(r - i), {language.PROFILE})) AS d, count(*) AS size
        FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g GROUP BY o.doc_id, l.lang
    ),
    nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) AS n FROM distances) WHERE n = 1)
    SELECT f.doc_id, fold = 2 AS held_out, coalesce(n.lang, '{language.UNDETERMINED}') AS lang_pred, CASE WHEN n.lang IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - d::DOUBLE / ({language.PROFILE} * size) END AS score
    FROM folded f LEFT JOIN nearest n ON n.doc_id = f.doc_id"""


def _licences() -> str:
    quoted = lambda x: "'" + x + "'"
    word_rows = []
    for t, (label, text, key) in enumerate(licences.TEMPLATES):
        own, phrase = text.split(), key.split()
        k = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        word_rows += [f"({t}, {quoted(label)}, {i}, {quoted(w)}, {int(k <= i < k + len(phrase))})" for i, w in enumerate(own)]
    base = [f"({quoted(p)}, {quoted(label)})" for p, label in licences.BASE]
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH template(t, label, q, word, is_key) AS (VALUES {', '.join(word_rows)}),
    base(phrase, label) AS (VALUES {', '.join(base)}),
    files AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM files),
    lexical AS (SELECT * FROM placed WHERE word IN (SELECT word FROM template)),
    df AS (SELECT word, count(DISTINCT doc_id) AS df FROM lexical GROUP BY word),
    weighed AS (
        SELECT t, label, q, template.word, is_key, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 0.001 AS idf
        FROM template LEFT JOIN df ON df.word = template.word
    ),
    begins AS (SELECT DISTINCT doc_id, t, p - q AS start FROM lexical JOIN weighed ON weighed.word = lexical.word WHERE is_key = 1),
    totals AS (SELECT t, sum(idf) AS total, sum(is_key) AS keys FROM weighed GROUP BY t),
    covers AS (
        SELECT b.doc_id, b.t, b.start, any_value(x.label) AS label, sum(idf) / any_value(total) AS cover, sum(is_key) AS met, any_value(keys) AS keys
        FROM begins b JOIN weighed x ON x.t = b.t JOIN lexical l ON l.doc_id = b.doc_id AND l.p = b.start + x.q AND l.word = x.word JOIN totals ON totals.t = b.t
        GROUP BY b.doc_id, b.t, b.start
    ),
    found AS (SELECT doc_id, label, cover FROM covers WHERE met = keys AND cover >= {licences.LEAST_COVER}),
    phrases AS (
        SELECT a.doc_id, a.p, label FROM base
        JOIN placed a ON a.word = split_part(phrase, ' ', 1)
        JOIN placed b ON b.doc_id = a.doc_id AND b.p = a.p + 1 AND b.word = split_part(phrase, ' ', 2)
        LEFT JOIN placed c ON c.doc_id = a.doc_id AND c.p = a.p + 2 AND c.word = split_part(phrase, ' ', 3)
        WHERE split_part(phrase, ' ', 3) = '' OR c.word IS NOT NULL
    ),
    based AS (SELECT doc_id, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM phrases GROUP BY doc_id),
    every AS (SELECT doc_id, label FROM phrases UNION SELECT doc_id, label FROM found),
    listed AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
    best AS (SELECT doc_id, max(cover) AS cover FROM found GROUP BY doc_id)
    SELECT f.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first::BIGINT AS first_word, b.last::BIGINT AS last_word,
        coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE least(coalesce(cover, 0), 1)::DOUBLE END AS score
    FROM files f LEFT JOIN based b ON b.doc_id = f.doc_id LEFT JOIN listed l ON l.doc_id = f.doc_id LEFT JOIN best ON best.doc_id = f.doc_id"""


URL_RULES = """
    WITH parts AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS raw, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    page AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
    rules(said, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    fits AS (SELECT page_id, said, r.host || r.path AS rule FROM page p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
    best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS ruled FROM fits GROUP BY page_id)
    SELECT p.page_id, host, path, rule, ruled FROM page p LEFT JOIN best b ON b.page_id = p.page_id"""


def _secret_base() -> str:
    """Matches are framed by a control character; a match's place is the length of all that stands before it."""
    kinds = (
        ("assign", """(?i:(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"),
    )
    value = """(?i:(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?)"""
    parts = []
    for i, (kind, pattern) in enumerate(kinds):
        size = {"assign": f"length(m) - length(regexp_extract(m, '^{value}')) >= 12", "access": "length(m) >= 18", "hex": "length(m) >= 16"}[kind]
        parts.append(f"""
            SELECT doc_id, {i} AS place, '{kind}' AS kind, a, a + length(m) AS b FROM (
                SELECT doc_id, p[i] AS m, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT AS a
                FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM docs), unnest(range(2, len(p) + 1, 2)) r(i)
            ) WHERE {size}""")
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({' UNION ALL '.join(parts)}),
    joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS s FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM docs d LEFT JOIN joined j ON j.doc_id = d.doc_id"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _importance() -> str:
    """Each distinct feature's CRC32 is taken byte by byte over its bytes, with a table made by the polynomial."""
    runs = " UNION ALL ".join(
        f"SELECT origin, doc_id, len(w) AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS f FROM words WHERE len(w) >= {k}" for k in (1, 2, 3)
    )
    return f"""
    WITH bytes AS MATERIALIZED (
        SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY v) AS crc FROM (SELECT unnest(range(256)) AS v)
    ),
    texts AS (SELECT 's' AS origin, doc_id, {_LOWER} AS t FROM documents UNION ALL SELECT 't', NULL, {_LOWER} FROM benchmark),
    words AS MATERIALIZED (SELECT origin, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
    runs AS ({runs}),
    counted AS MATERIALIZED (SELECT origin, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
    hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
    bucketed AS MATERIALIZED (
        SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
            lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1]))) % 10000 AS b
        FROM hexed, bytes
    ),
    held AS (SELECT b, sum(n) FILTER (origin = 's') AS s, sum(n) FILTER (origin = 't') AS t FROM counted JOIN bucketed USING (f) GROUP BY b),
    every AS (SELECT b, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t FROM held),
    sums AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM every),
    gain AS (SELECT b, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g FROM every, sums),
    weighed AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM counted JOIN bucketed USING (f) JOIN gain USING (b) WHERE origin = 's' GROUP BY doc_id),
    docs AS (
        SELECT w.doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            ('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT AS h
        FROM words w LEFT JOIN weighed x ON x.doc_id = w.doc_id WHERE origin = 's'
    ),
    marked AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (count(*) OVER ()) * 5 // 100 AS drawn FROM marked WHERE n_words >= 20)
    SELECT m.doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM marked m LEFT JOIN placed p ON p.doc_id = m.doc_id"""


LINE_DEDUP = """
    WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    told AS (SELECT doc_id, line, i, key IN (SELECT key FROM gone) AS drop FROM keyed)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '')) AS kept_sha256
    FROM told GROUP BY doc_id"""

COLLOCATIONS = f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    words AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    runs AS (
        {" UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM words WHERE len(w) >= {k}" for k in (1, 2, 3, 4))}
    ),
    f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
    cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
    cuts AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM cand),
    parts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), score * 10 + k) AS x FROM parts GROUP BY ALL),
    inside AS (SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(1, size)) AS i FROM cand), unnest(range(2, 5)) r(j) WHERE j > i AND j <= size AND j - i + 1 < size),
    longest AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN longest s ON s.lang = b.lang AND s.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * b.a),
    ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank, phrase, a, x.l AS l, x.r AS r, x.score AS score FROM kept)
    SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": NEAR_DEDUP,
        "op3_vector_dedup": VECTOR_DEDUP,
        "op5_language": LANGUAGE,
        "op6_licences": _licences(),
        "op8_mixing": MIXING,
        "op9_topk": TOPK,
        "op10_warc": WARC,
        "op11_importance": _importance(),
        "op12_line_dedup": LINE_DEDUP,
        "op13_collocations": COLLOCATIONS,
        "url_rules": URL_RULES,
        "secret_base": _secret_base(),
    }
