"""DuckDB SQL of the operators that SQL can express, written apart from them."""

from __future__ import annotations

# Words, shingles of five words (fewer words: the whole item), every window of an
# item's size that holds a shared shingle; the best one each, among equals one
# that places a shared shingle as the item does.
DECONTAMINATE = r"""
WITH w AS (SELECT doc_id, r, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]+', '', 'g'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM (SELECT *, row_number() OVER () AS r FROM documents)),
i AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k FROM (
        SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]+', '', 'g'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
ip AS (SELECT item_id, n, k, o, array_to_string(ws[o + 1:o + k], ' ') AS s
       FROM (SELECT *, unnest(range(0, n - k + 1)) AS o FROM i)),
ks AS (SELECT DISTINCT k FROM i),
dp AS (SELECT doc_id, r, k, p, size, array_to_string(ws[p + 1:p + k], ' ') AS s
       FROM (SELECT doc_id, r, ws, k, len(ws) AS size, unnest(range(0, len(ws) - k + 1)) AS p FROM w, ks)),
hits AS (SELECT DISTINCT doc_id, r, dp.k, n, p, size, dp.s FROM dp JOIN ip ON dp.s = ip.s AND dp.k = ip.k),
laid AS (SELECT DISTINCT doc_id, r, k, n, size,
           unnest(range(greatest(0, p - least(size, n) + k), least(p, greatest(0, size - n)) + 1)) AS first FROM hits),
placed AS (SELECT DISTINCT r, dp.k, ip.n, greatest(0, least(p - o, size - ip.n)) AS first
           FROM dp JOIN ip ON dp.s = ip.s AND dp.k = ip.k),
bag AS (SELECT laid.doc_id, laid.r, laid.k, laid.n, laid.first, laid.size, hits.s, count(*) AS c FROM laid JOIN hits
          ON laid.r = hits.r AND laid.k = hits.k AND laid.n = hits.n AND hits.p BETWEEN laid.first AND laid.first + laid.n - laid.k
        GROUP BY ALL),
ibag AS (SELECT item_id, n, k, s, count(*) AS c FROM ip GROUP BY ALL),
common AS (SELECT doc_id, item_id, r, bag.k, bag.n, first, size, sum(least(bag.c, ibag.c)) AS c
           FROM bag JOIN ibag ON bag.s = ibag.s AND bag.k = ibag.k AND bag.n = ibag.n GROUP BY ALL),
scored AS (SELECT doc_id, item_id, common.first, (placed.r IS NOT NULL)::INTEGER AS placed,
             c / (least(size, common.n) - common.k + 1 + common.n - common.k + 1 - c)::DOUBLE AS similarity
           FROM common LEFT JOIN placed ON placed.r = common.r AND placed.k = common.k AND placed.n = common.n AND placed.first = common.first)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(first, (similarity, placed, -first))::INTEGER AS first_word
FROM scored WHERE similarity >= 0.8 AND doc_id IS NOT NULL GROUP BY doc_id, item_id
"""

# Words one by one; thresholds and stop words stated anew.
QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM x
      WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM g WHERE tri IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
st AS (SELECT r, count(*) AS n FROM x WHERE list_contains(string_split(
         'a and are as at be by for from in is it of on that the this to was with '
         || 'auf das den der des die ein für ist mit nicht sich und von zu '
         || 'con de del el en la las los no para por que se un una y '
         || 'au dans du est et le les par pas pour qui sur une', ' '), lower(word)) GROUP BY r),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
       coalesce(st.n, 0)::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r) LEFT JOIN st USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR n_repeat_words * 2 > n_words) AS base_failed,
  -- Words of 2 to 15 characters on average, at most 15 symbols and at least 4
  -- stop words in a hundred words, at most half of the lines repeated.
  (n_words >= 50 AND n_repeat_words * 2 <= n_words AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
   AND 100 * n_symbols <= 15 * n_words AND 25 * n_stop_words >= n_words AND 2 * n_dup_lines <= n_lines) AS kept,
  n_stop_words, n_lines
FROM s
"""

# Bytes as hexadecimal digits; a string of 50 bytes is 100 digits.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS smallest FROM p GROUP BY s),
g AS (SELECT DISTINCT p.doc_id, p.i FROM p JOIN m USING (s) WHERE m.smallest < p.doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span),
pieces AS (SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1,
                                    2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS piece
           FROM spans JOIN d USING (doc_id)
           UNION ALL
           SELECT doc_id, length(h), substr(h, 2 * max(b) + 1) FROM spans JOIN d USING (doc_id) GROUP BY doc_id, h),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS k FROM pieces GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


# Rules in the order in which they win; paths of up to five segments, three
# rounds of splitting chains: more than the tables need.
URL_RULES = (("block", "example.com", "/de/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/"), ("block", "net", "/"))
URL_DEPTH, URL_ROUNDS = 5, 3


def url_sql() -> str:
    """The URL filter: the levels of the template tree one after the other."""
    def case(value):
        whens = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{value(a, h, p)}'"
                         for a, h, p in URL_RULES)
        return f"CASE {whens} END"

    def down(n, b, l, prior):
        return f"({b} + ({n} - {l}) * 0.5::DOUBLE + {prior} * 2.0::DOUBLE) / ({n} + 2.0::DOUBLE)"

    ctes = [f"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
            f"""rows AS (SELECT *, {case(lambda a, h, p: h + p)} AS rule, {case(lambda a, h, p: a)} AS action,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
                 lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS segs FROM u)""",
            """p AS (SELECT host, segs, count(*) AS n, count(*) FILTER (WHERE action = 'block') AS blocked, count(action) AS labelled
  FROM rows GROUP BY host, segs)""",
            f"""t AS (SELECT host, {down('sum(n)', 'sum(blocked)', 'sum(labelled)', '0.5::DOUBLE')} AS share, sum(n) AS m FROM p GROUP BY host)""",
            """o0 AS (SELECT p.*, '' AS template, share AS prior, share, m >= 3 AND len(segs) > 0 AS going, m < 3 AND len(segs) > 0 AS tail
  FROM p JOIN t USING (host))"""]
    for k in range(URL_DEPTH):
        ctes += [f"""h{k} AS (SELECT *, CASE WHEN n < 3 AND seg <> '*' THEN CASE WHEN labelled = 0 THEN '?' ELSE '*' END ELSE seg END AS branch
  FROM (SELECT host, template, segs[{k + 1}] AS seg, sum(n) AS n, sum(blocked) AS blocked, sum(labelled) AS labelled
        FROM o{k} WHERE going GROUP BY ALL))""",
                 f"""l{k} AS (SELECT host, template, branch, blocked, labelled FROM h{k} WHERE branch NOT IN ('*', '?') AND labelled > 0)""",
                 f"""s{k}_0 AS (SELECT *, share * (1 - share) / (labelled + 2.0::DOUBLE) AS error2 FROM (
  SELECT host, template, blocked, labelled, count(*) AS siblings, (blocked + 1.0::DOUBLE) / (labelled + 2.0::DOUBLE) AS share
  FROM l{k} GROUP BY ALL))"""]
        for j in range(URL_ROUNDS):
            ctes += [f"""c{k}_{j} AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY host, template ORDER BY share, labelled) AS run FROM (
  SELECT *, CASE WHEN share - lag(share) OVER w <= 1.96::DOUBLE * sqrt(error2 + lag(error2) OVER w) THEN 0 ELSE 1 END AS fresh
  FROM s{k}_{j} WINDOW w AS (PARTITION BY host, template ORDER BY share, labelled)))""",
                     f"""g{k}_{j} AS (SELECT *, (b + 1.0::DOUBLE) / (l + 2.0::DOUBLE) AS p FROM (SELECT *, sum(blocked * siblings) OVER r AS b,
  sum(labelled * siblings) OVER r AS l FROM c{k}_{j} WINDOW r AS (PARTITION BY host, template, run)))""",
                     f"""d{k}_{j} AS (SELECT *, abs(share - p) <= 1.96::DOUBLE * sqrt(error2 + p * (1 - p) / (l + 2.0::DOUBLE))
  OR row_number() OVER (PARTITION BY host, template, run ORDER BY abs(share - p), share, labelled) = 1 AS stays FROM g{k}_{j})""",
                     f"""s{k}_{j + 1} AS (SELECT host, template, blocked, labelled, siblings, share, error2 FROM d{k}_{j} WHERE NOT stays)"""]
        settled = " UNION ALL ".join(f"SELECT host, template, blocked, labelled, '{j}.' || run AS run FROM d{k}_{j} WHERE stays"
                                     for j in range(URL_ROUNDS))
        ctes += [f"""a{k} AS (SELECT l{k}.*, x.run FROM l{k} JOIN ({settled}) x USING (host, template, blocked, labelled))""",
                 f"""m{k} AS (SELECT host, template, branch, CASE WHEN count(*) OVER w = 1 THEN branch
  WHEN count(*) OVER w <= 20 THEN '{{' || array_to_string(list_sort(list(branch) OVER w), ',') || '}}'
  ELSE '{{' || min(branch) OVER w || ',?,' || max(branch) OVER w || '}}' END AS merged
  FROM a{k} WINDOW w AS (PARTITION BY host, template, run))""",
                 f"""n{k} AS (SELECT h.*, coalesce(m.merged, h.branch) AS merged FROM h{k} h LEFT JOIN m{k} m USING (host, template, branch))""",
                 f"""v{k} AS (SELECT *, sum(n) OVER w AS mn, sum(blocked) OVER w AS mb, sum(labelled) OVER w AS ml
  FROM n{k} WINDOW w AS (PARTITION BY host, template, merged))""",
                 f"""o{k + 1} AS (SELECT * FROM o{k} WHERE NOT going UNION ALL
  SELECT o.host, o.segs, o.n, o.blocked, o.labelled, o.template || '/' || v.merged,
    CASE WHEN len(o.segs) > {k + 1} AND mn < 3 THEN {down('mn', 'mb', 'ml', 'o.share')} ELSE o.share END,
    {down('mn', 'mb', 'ml', 'o.share')}, len(o.segs) > {k + 1} AND mn >= 3, len(o.segs) > {k + 1} AND mn < 3
  FROM o{k} o JOIN v{k} v ON o.host = v.host AND o.template = v.template AND o.segs[{k + 1}] = v.seg WHERE o.going)"""]
    ctes += ["""w AS (SELECT segs, sum(blocked) AS b, sum(labelled) AS l FROM p GROUP BY segs)""",
             f"""x AS (SELECT o.host, o.segs, o.n, o.blocked, o.labelled, o.template || CASE WHEN tail THEN '/**' ELSE '' END AS template,
  (w.b + o.prior * 2.0::DOUBLE) / (w.l + 2.0::DOUBLE) AS prior FROM o{URL_DEPTH} o JOIN w ON o.segs = w.segs)""",
             """y AS (SELECT host, template, round((sum(blocked) + sum(prior * n) / sum(n) * 2.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE), 9)
  AS purity FROM x GROUP BY host, template)"""]
    return "WITH " + ",\n".join(ctes) + """
SELECT page_id, rows.host, path, rule, coalesce(action, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
  x.template, purity FROM rows JOIN x ON rows.host = x.host AND rows.segs = x.segs JOIN y ON x.host = y.host AND x.template = y.template"""


# Pieces, words and all runs of one to four words of a piece, counted.
COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
        SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a) // (x.a + y.a) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, array_to_string(ws[q:q + z - 1], ' ') AS phrase FROM c, (SELECT unnest([1, 2, 3]) AS q),
        (SELECT unnest([2, 3]) AS z) WHERE z < m AND q + z - 1 <= m),
h AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER o AS rank, b.phrase, b.a, l, r, t.n::BIGINT AS n, score::BIGINT AS score
FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase JOIN t ON t.lang = b.lang
WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a
WINDOW o AS (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase)
QUALIFY row_number() OVER o <= 2000
"""

# Texts as words; the orders of the five letters; every step from the set of
# filters that a document fails.
AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
f AS (SELECT r, doc_id, part, (len(ws) < 200) AS a, (100 * len(list_distinct(ws)) < 50 * len(ws)) AS b,
        (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t)) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(smallest < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT f.r, part, unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([a, b, c, d, e]) AS fails,
        concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS failed,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT concat(s1.letter, s2.letter, s3.letter, s4.letter, s5.letter) AS filter_order
      FROM s s1, s s2, s s3, s s4, s s5 WHERE len(list_distinct([s1.letter, s2.letter, s3.letter, s4.letter, s5.letter])) = 5),
p AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
u AS (SELECT part, filter, failed, fails, good, toxic, count(*) AS n FROM x GROUP BY ALL),
q AS (SELECT u.part, p.filter_order, p.step, p.filter, u.n, u.fails, u.failed, u.good, u.toxic,
        length(translate(u.failed, p.before, '')) < length(u.failed) AS gone FROM p JOIN u USING (filter)),
g AS (SELECT part, filter_order, step, filter,
        sum(n) FILTER (WHERE NOT fails AND NOT gone) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed,
        sum(n) FILTER (WHERE fails AND gone) AS redundant, sum(n) FILTER (WHERE failed = filter) AS unique_fails,
        sum(n) FILTER (WHERE fails AND NOT gone AND good) AS good_lost, sum(n) FILTER (WHERE fails AND NOT gone AND toxic) AS toxic_lost
      FROM q GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley, filter FROM g
"""

# CRC-32 byte by byte from its table; the jump function with integers of 128 bits.
SHARDS = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                    ORDER BY i) AS step FROM (SELECT unnest(range(256)) AS i)),
b AS (SELECT r, doc_id, octet_length(t) + 8 AS size, list_concat([4294967295], list_transform(regexp_extract_all(hex(t), '..'),
        lambda x: ('0x' || x)::BIGINT)) AS bytes FROM d),
s AS (SELECT r, doc_id, size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]))) AS text_crc32
      FROM b, crc),
j AS (SELECT r, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::HUGEINT AS k, 0 AS step,
        -1::BIGINT AS last, 0::BIGINT AS nxt FROM d
      UNION ALL
      SELECT r, ((k * 2862933555777941757 + 1) % 18446744073709551616)::HUGEINT, step + 1, nxt,
        trunc((nxt + 1) * (2147483648::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT
      FROM j WHERE nxt < 25),
e AS (SELECT r, max(last) FILTER (WHERE last < 24) AS shard, max(last) AS grown FROM j GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM s JOIN e USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": DECONTAMINATE,
        "op7_suffix_dedup": SUFFIX,
        "op9_quality_rules": QUALITY_RULES,
        "op10_url_filter": url_sql(),
        "op11_collocations": COLLOCATIONS,
        "op12_filter_audit": AUDIT,
        "op13_jump_shards": SHARDS,
    }
