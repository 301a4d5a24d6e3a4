"""The queries in DuckDB's SQL, for those that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from duelframe.llm import archives, audit, links, quality, search, secret_scan
from duelframe.llm.common import BLANKS, NOT_BLANK


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lowered(value: str) -> str:
    return f"translate({value}, '{ascii_uppercase}', '{ascii_lowercase}')"


def url_filters(rules: tuple[tuple[str, str], ...], threshold: float = 0.6) -> str:
    listed = ", ".join(
        f"({quoted(verdict)}, {quoted(rule)}, {quoted(rule.partition('/')[0])}, "
        f"{quoted(rule[len(rule.partition('/')[0]):])})"
        for verdict, rule in rules
    )
    kept, rounds = links.KEPT, links.rounds_for()
    steps = "".join(
        f""",
mass{k} AS MATERIALIZED (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT kind, host, seed * {1 - kept}::DOUBLE AS mass FROM seeds
    UNION ALL
    SELECT e.kind, e.dst, m.mass * {kept}::DOUBLE / e.n
    FROM mass{k - 1} m JOIN e ON m.kind = e.kind AND m.host = e.src)
  GROUP BY ALL)"""
        for k in range(1, rounds + 1)
    )
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS n, page_id, html,
         coalesce({lowered(f"regexp_extract(url, {quoted(links.HOST)}, 1)")}, '') AS host,
         coalesce(regexp_extract(url, {quoted(links.PATH)}, 1), '') AS path
  FROM pages),
rules(verdict, rule, at_host, at_path) AS (VALUES {listed}),
fit AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
  FROM p JOIN rules r ON (host = at_host OR ends_with(host, '.' || at_host))
                     AND starts_with(path, at_path)
  GROUP BY n),
judged AS (SELECT p.*, rule, verdict FROM p LEFT JOIN fit USING (n)),
shares AS (
  SELECT host, count(*) FILTER (verdict = 'allow')::DOUBLE / count(*) AS trust,
         count(*) FILTER (verdict = 'block')::DOUBLE / count(*) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
seeds AS (
  SELECT 'trust' AS kind, host, trust AS seed FROM shares WHERE trust > 0
  UNION ALL SELECT 'distrust', host, distrust FROM shares WHERE distrust > 0),
linked AS (
  SELECT host AS src, {lowered("unnest(regexp_extract_all(html, " + quoted(links.LINK) + ", 1))")} AS dst
  FROM p),
edges AS (
  SELECT DISTINCT src, dst FROM linked
  WHERE src <> '' AND dst <> '' AND src <> dst),
both_ways AS (
  SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
e AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS n FROM both_ways),
mass0 AS (SELECT kind, host, seed AS mass FROM seeds){steps},
held AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust,
         coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM mass{rounds} GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN distrust > (trust + distrust) * {threshold * (1 + links.SAME)}::DOUBLE
                              THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN held USING (host)"""


def secret_scans() -> str:
    rules = secret_scan.BASE + secret_scan.ADDED
    each = []
    for no, rule in enumerate(rules):
        regex = quoted(rule.regex)
        each.append(f"""
  SELECT n, {no} AS no, {quoted(rule.kind)} AS kind, unnest(list_transform(
    range(1, len(m) + 1),
    lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                'l': length(m[i]), 't': length(t[i])}})) AS x
  FROM (SELECT n, regexp_extract_all(text, {regex}, 0) AS m, string_split_regex(text, {regex}) AS g,
               regexp_extract_all(text, {regex}, {rule.group}) AS t FROM d)""")
    least = " ".join(f"WHEN {no} THEN {rule.least}" for no, rule in enumerate(rules))
    shown = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e)"
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(each)}),
kept AS (
  SELECT n, no, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.l AS BIGINT) AS e FROM spans
  WHERE x.t >= CASE no {least} END)
SELECT doc_id, {", ".join(count(rule.kind) for rule in secret_scan.BASE)},
       sha256(coalesce({shown} FILTER (no < {len(secret_scan.BASE)}), '')) AS base_sha256,
       coalesce({shown}, '') AS spans
FROM d LEFT JOIN kept USING (n) GROUP BY d.n, doc_id"""


def quality_rules() -> str:
    group = ", ".join(quality.GROUP)
    measures = ", ".join(f"{m.of.replace(' div ', ' // ')} AS {m.name}" for m in quality.MEASURES)
    values = " UNION ALL ".join(
        f"SELECT {group}, '{m.name}' AS measure, {m.name} AS v FROM m WHERE NOT base_failed"
        for m in quality.MEASURES
    )
    of = lambda field: " ".join(f"WHEN '{m.name}' THEN {getattr(m, field)}" for m in quality.MEASURES)
    fences = lambda name, by: f"""
{name} AS (
  SELECT {by}measure, docs,
         CASE WHEN CASE measure {of("below")} END THEN middle - (middle - lower) * reach - guard END AS low,
         middle + (upper - middle) * reach + guard AS high
  FROM (
    SELECT {by}measure, docs, CASE measure {of("reach")} END AS reach, CASE measure {of("guard")} END AS guard,
           min(bucket) FILTER (upto * 100 >= docs * (100 - CASE measure {of("at")} END)) AS lower,
           min(bucket) FILTER (upto * 100 >= docs * 50) AS middle,
           min(bucket) FILTER (upto * 100 >= docs * CASE measure {of("at")} END) AS upper
    FROM (
      SELECT {by}measure, bucket, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto,
             sum(n) OVER (PARTITION BY {by}measure) AS docs
      FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL))
    GROUP BY ALL))"""  # noqa: E731
    outside = " OR ".join(
        f"coalesce(measure = '{m.name}' AND ({m.name} > high"
        + (f" OR {m.name} < low" if m.below else "")
        + "), false)"
        for m in quality.MEASURES
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{NOT_BLANK}')) AS ls
  FROM documents),
triples AS (
  SELECT n, i, ws[i:i + 2] AS w FROM (SELECT n, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
repeated AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, w) AS c FROM triples) WHERE c > 1),
covered AS (
  SELECT n, count(DISTINCT i + k) AS n_repeat_words
  FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY n),
stats AS (
  SELECT n, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^{quality.SYMBOLS}]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines
  FROM d LEFT JOIN covered USING (n)),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {measures} FROM stats),
sketch AS (
  SELECT {group}, measure, v - v % (1 << greatest(length(bin(v)) - 8, 0)) AS bucket, count(*) AS n
  FROM ({values}) GROUP BY ALL),{fences("own", group + ", ")},{fences("by_lang", "lang, ")},{fences("by_all", "")},
chosen AS (
  SELECT o.lang, o.source, o.measure,
         CASE WHEN o.docs >= {quality.MIN_DOCS} THEN o.low WHEN l.docs >= {quality.MIN_DOCS} THEN l.low
              ELSE a.low END AS low,
         CASE WHEN o.docs >= {quality.MIN_DOCS} THEN o.high WHEN l.docs >= {quality.MIN_DOCS} THEN l.high
              ELSE a.high END AS high
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
             JOIN by_all a ON o.measure = a.measure),
far AS (
  SELECT n, bool_or({outside}) AS outside
  FROM m JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
  GROUP BY n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM m LEFT JOIN far USING (n)"""


def line_dedup() -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, text,
         dense_rank() OVER (ORDER BY doc_id NULLS FIRST, text) AS id FROM documents),
docs AS (SELECT DISTINCT id, doc_id, text FROM d WHERE text IS NOT NULL),
lines AS (
  SELECT id, i, string_split(text, chr(10))[i] AS x FROM (
    SELECT id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
worded AS (SELECT * FROM lines WHERE regexp_matches(x, '{NOT_BLANK}')),
windows AS (
  SELECT id, [i, lead(i) OVER w, lead(i, 2) OVER w] AS places, [x, lead(x) OVER w, lead(x, 2) OVER w] AS xs
  FROM worded WINDOW w AS (PARTITION BY id ORDER BY i)),
later AS (
  SELECT id, places FROM (
    SELECT *, row_number() OVER (PARTITION BY xs ORDER BY id, places[1]) AS nth FROM windows
    WHERE places[3] IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT id, unnest(places) AS i FROM later),
kept AS (
  SELECT id, string_agg(x, chr(10) ORDER BY i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines,
         count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g USING (id, i) GROUP BY id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN kept k USING (id)"""


def warc() -> str:
    return f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {archives.LEAST_BYTES} AND holder IS DISTINCT FROM page_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {archives.LEAST_BYTES} AND holder IS DISTINCT FROM page_id
            THEN holder END AS refers_to
FROM h"""


def lexical_search() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = f"regexp_extract_all({lowered('text')}, '{term}')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {found} AS ts FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
sized AS (SELECT r, doc_id, 75 + (25 * n * docs) // terms AS m FROM docs, corpus),
counted AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY t),
items AS (SELECT row_number() OVER () AS q, item_id, {found} AS ts FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(ts) AS t FROM items) GROUP BY ALL),
scored AS (
  SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN counted USING (t) JOIN sized USING (r) GROUP BY ALL),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS nth
  FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(nth AS INTEGER) AS rank, doc_id, score
FROM ranked JOIN items USING (q) WHERE nth <= {search.TOP}"""


def filter_audit() -> str:
    orders = ", ".join(f"('{o}')" for o in audit.ORDERS)
    bits = lambda s: " + ".join(
        f"(CASE WHEN contains({s}, '{x}') THEN {1 << k} ELSE 0 END)" for k, x in enumerate(audit.FILTERS)
    )
    count = lambda where, of="true": (
        f"CAST(coalesce(sum(n) FILTER (({where}) AND ({of})), 0) AS BIGINT)"
    )
    here = "mask & own > 0 AND mask & before = 0"
    shapley = " ".join(f"WHEN {k} THEN {120 // k}" for k in range(1, 6))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda w: w <> '') AS ws
  FROM documents),
l AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(text, '[{audit.SYMBOLS}]') THEN 8 ELSE 0 END)
       + (CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id
                 OR doc_id IS NULL AND min(doc_id) OVER (PARTITION BY text) IS NOT NULL THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN l USING (doc_id)),
counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
orders(filter_order) AS (VALUES {orders}),
steps AS (
  SELECT filter_order, step, {bits("filter_order[step]")} AS own,
         {bits("substring(filter_order, 1, step - 1)")} AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step))
SELECT part, filter_order, step,
       {count("mask & (own | before) = 0")} AS kept,
       {count(here)} AS removed,
       {count("mask & own > 0 AND mask & before > 0")} AS redundant,
       {count("mask = own")} AS unique_fails,
       {count(here, "good")} AS good_lost,
       {count(here, "toxic")} AS toxic_lost,
       CAST(coalesce(sum(n * CASE bit_count(mask) {shapley} END) FILTER (mask & own > 0), 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""
