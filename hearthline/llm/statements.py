"""SQL that states the numbered queries a second time, where SQL can."""

SQL: dict[str, str] = {}

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op7_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE],
    CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS wt,
    source_size * 2.0::DOUBLE AS most FROM s),
r AS (SELECT *, most / wt AS reach, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(wt) OVER () AS all_w FROM w),
o AS (SELECT *, coalesce(sum(most) OVER x, 0) AS before, all_w - coalesce(sum(wt) OVER x, 0) AS rest FROM r
  WINDOW x AS (ORDER BY reach, wt, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - before) / rest AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN reach > level
    THEN wt * max(CASE WHEN reach > level THEN level END) OVER () ELSE most END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
h AS (SELECT source, place, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, place),
c AS (SELECT h.source, h.place, h.size, sum(h.size) OVER (PARTITION BY h.source ORDER BY h.place) AS upto,
    g.target - g.copies * g.source_size AS need FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
u AS (SELECT source, CASE WHEN upto - need < need - (upto - size) THEN place + 1 ELSE place END AS under
  FROM c WHERE upto - size <= need AND need < upto)
SELECT d.doc_id, d.size, g.source_size, CAST(g.target AS DOUBLE) AS target,
  CAST(d.size * (g.copies + CASE WHEN d.place < coalesce(u.under, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source"""

SQL["op5_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS words
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.words = bw.words),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)"""

SQL["op3_warc"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n > 1 AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)"""


WORDS = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
HASHES = """CASE WHEN len({0}) = 0 THEN []::VARCHAR[] ELSE list_slice(list_sort(list_distinct(list_transform(
  generate_series(1, greatest(len({0}) - 4, 1)), lambda i: upper(substr(md5(array_to_string(list_slice({0}, i, i + 4), ' ')), 1, 16))))), 1, 128) END"""
NEAR = """CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({0}, lambda x: list_contains({1}, x)
  AND list_contains(list_slice(list_sort(list_distinct(list_concat({0}, {1}))), 1, 128), x)))::DOUBLE
  / least(len(list_distinct(list_concat({0}, {1}))), 128) END"""

SQL["op11_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, count(*) AS copies FROM documents GROUP BY ALL),
o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d
  WINDOW w AS (ORDER BY doc_id NULLS LAST, md5(t) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(t, n - n // 4) || left(nt, n // 4) AS x FROM o),
w AS (SELECT *, {WORDS.format("t")} AS tw, {WORDS.format("x")} AS xw, {WORDS.format("nt")} AS nw FROM e),
h AS (SELECT *, {HASHES.format("tw")} AS a, {HASHES.format("xw")} AS b, {HASHES.format("nw")} AS c FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(x) AS edited_sha256, base64(unhex(array_to_string(a, ''))) AS fingerprint,
  base64(unhex(array_to_string(b, ''))) AS edited_fingerprint, {NEAR.format("a", "b")} AS near_edited, {NEAR.format("a", "c")} AS near_next
FROM (SELECT *, unnest(generate_series(1, copies)) AS copy FROM h)"""

SQL["op13_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
g AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain'
      WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid,
    array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS made FROM p),
r AS (SELECT *, string_split_regex(made, '<P>|<S>|<M>') AS s FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(made) AS output_sha256, sha256(CASE form WHEN 'plain' THEN made WHEN 'psm' THEN s[2] || s[4] || s[3] ELSE s[3] || s[4] || s[2] END) AS restored_sha256
FROM r"""
