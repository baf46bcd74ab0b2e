"""SQL statements that give the results of the queries that SQL can express, on the same tables.

They restate the definitions: the checksum byte by byte, the jump hash as a recursion, repeated strings
by grouping every string of the corpus.
"""

# The polynomial of CRC-32, and the multiplier of the jump hash.
_SHARDS = """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                   lambda x: CAST('0x' || x AS BIGINT)) AS octets
  FROM documents),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], octets),
    lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, crc_table),
jump(doc_id, n, shard, next, state) AS (
  SELECT doc_id, n, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(doc_id AS HUGEINT)
  FROM documents, (SELECT unnest([24, 25]) AS n)
  UNION ALL
  SELECT doc_id, n, next,
    CAST(floor((next + 1) * (CAST(2147483648 AS DOUBLE) / CAST(s // 8589934592 + 1 AS DOUBLE)))
         AS BIGINT), s
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s
        FROM jump WHERE next < n)),
placed AS (
  SELECT doc_id, CAST(max(shard) FILTER (WHERE n = 24) AS INTEGER) AS shard,
    CAST(max(shard) FILTER (WHERE n = 25) AS INTEGER) AS grown_shard
  FROM jump WHERE next >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums JOIN placed USING (doc_id)"""

# Texts go through hexadecimal, two characters a byte; they are cut in pieces first, as reaching into
# a long text takes as long as its beginning.
_REPEATS = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
    CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
pieces AS (
  SELECT doc_id, j, n, substring(h, 2 * j + 1, 2198) AS piece
  FROM (SELECT *, unnest(range(0, n - 99, 1000)) AS j FROM texts)),
strings AS (
  SELECT doc_id, j + i AS i, md5(substring(piece, 2 * i + 1, 200)) AS s
  FROM (SELECT *, unnest(range(0, least(1000, n - 99 - j))) AS i FROM pieces)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings)
  WHERE r > 1),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
      SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END
        AS fresh FROM later))
  GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(z), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substring(h, 2 * x + 1)
                                 ELSE substring(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS k
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id),
removed AS (
  SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""



def _mixed(a, b, c):
    """The generator of the mix: its prime and multipliers are fixed values."""
    prime = 2147483647
    t = f"((({a}) % {prime}) * 1597334677 + ({a}) // {prime}) % {prime}"
    t = f"(({t}) * 812015047 + ({b}) % {prime} + 1) % {prime}"
    t = f"(({t}) * 1103515245 + ({c}) % {prime} + 1) % {prime}"
    return f"((({t}) * ({t}) + 69621) % {prime} * 1597334677 + 812015047) % {prime}"


def _drawn(below, a, b, c):
    return f"(({_mixed(a, b, 2 * c)}) * 2147483647 + {_mixed(a, b, 2 * c + 1)}) % {below}"


_IMAGE = "((mirrors[r + 1] + blocks - x) % blocks)"

# Blocks of 128 words, shares of 150 %, twice each source's size at most; 32 rounds a permutation.
_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS id,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sized),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[rank % 3 + 1] AS weight FROM named),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, rank) AS place FROM weighed),
filled AS (
  SELECT *, 1.5 * sum(source_size) OVER () - 2 * (sum(source_size) OVER (ORDER BY place) - source_size)
      AS words_left,
    CAST(sum(weight) OVER () - (sum(weight) OVER (ORDER BY place) - weight) AS DOUBLE) AS weight_left
  FROM ordered),
bounded AS (
  SELECT *, min(CASE WHEN 2 * source_size * weight_left <= weight * words_left THEN 1 ELSE 0 END)
    OVER (ORDER BY place) = 1 AS at_bound FROM filled),
aimed AS (
  SELECT rank, source, source_size, (source_size + 127) // 128 AS blocks,
    CASE WHEN at_bound THEN CAST(2 * source_size AS DOUBLE) ELSE weight
      * CAST(arg_min(words_left, place) FILTER (WHERE NOT at_bound) OVER () AS DOUBLE)
      / arg_min(weight_left, place) FILTER (WHERE NOT at_bound) OVER () END AS target FROM bounded),
quotas AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2 * blocks,
    CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) END AS quota FROM aimed),
sources AS (
  SELECT *, CAST(sum(quota) OVER (ORDER BY rank) - quota AS BIGINT) AS first,
    CAST(sum(quota) OVER (ORDER BY rank) AS BIGINT) AS last, CAST(sum(quota) OVER () AS BIGINT) AS n
  FROM quotas),
draws AS (
  SELECT slot, {_drawn("n", "slot", 1, 0)} AS draw
  FROM (SELECT unnest(range(n)) AS slot, n FROM (SELECT max(n) AS n FROM sources))),
turns AS (
  SELECT rank, quota, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn
  FROM draws JOIN sources ON draw >= first AND draw < last),
spare AS (
  SELECT row_number() OVER (ORDER BY rank, turn) AS j FROM turns WHERE turn >= quota),
missing AS (
  SELECT rank, turn, row_number() OVER (ORDER BY rank, turn) AS j
  FROM (SELECT rank, unnest(range(quota)) AS turn FROM sources) WHERE (rank, turn) NOT IN
    (SELECT (rank, turn) FROM turns)),
final AS (
  SELECT rank, turn FROM turns WHERE turn < quota UNION ALL
  SELECT rank, turn FROM missing JOIN spare USING (j)),
seeded AS (
  SELECT source, blocks, turn % blocks AS i, rank * 2 + turn // blocks AS seed
  FROM final JOIN sources USING (rank)),
mirrored AS (
  SELECT *, list_transform(range(32), lambda q: {_drawn("blocks", "q", "seed", 1)}) AS mirrors
  FROM (SELECT DISTINCT seed, blocks FROM seeded)),
taken AS (
  SELECT source, list_reduce(list_prepend(i, range(32)), lambda x, r:
    CASE WHEN {_mixed(f"greatest(x, {_IMAGE})", "seed", "r")} > 1073741823
         THEN {_IMAGE} ELSE x END) AS block
  FROM seeded JOIN mirrored USING (seed, blocks)),
times AS (SELECT source, block, count(*) AS times FROM taken GROUP BY ALL),
spans AS (
  SELECT id, p.source, b.block,
    least(start + size, b.block * 128 + 128) - greatest(start, b.block * 128) AS n_words
  FROM (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block
        FROM placed WHERE size > 0) AS b JOIN placed AS p USING (id, start, size)),
words AS (
  SELECT id, CAST(sum(n_words * times) AS BIGINT) AS taken
  FROM spans s JOIN times t ON s.source IS NOT DISTINCT FROM t.source AND s.block = t.block GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM placed p JOIN sources s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN words USING (id)"""

_SEARCH = """
WITH terms AS (
  SELECT doc_id, rowid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
lengths AS (SELECT rowid, doc_id, count(*) AS n FROM terms GROUP BY ALL),
figures AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
postings AS (
  SELECT rowid, term, count(*) AS tf FROM terms SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), figures),
impacts AS (
  SELECT rowid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms))) AS impact
  FROM postings JOIN weights USING (term) JOIN lengths USING (rowid), figures),
scores AS (
  SELECT item_id, rowid, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
  FROM impacts JOIN wanted USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0) WHERE rank <= 20"""

# Fixed value: the polynomial of CRC-32.
_CRC_TABLE = """
bits(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8)"""


def _edit(state, cost, initial, line=None):
    """The cheapest repair that ends in a state, with one more edit."""
    text = f"{state}.t" + (f" || chr(10) || {line}" if line else "")
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{initial}', t := {text})"


def _edited(states, cost, initial, line, allowed="TRUE"):
    return [
        f"CASE WHEN {x}.c IS NOT NULL AND {allowed} THEN {_edit(x, cost, initial, line)} END" for x in states
    ]


def _least(*ways):
    return f"least({', '.join(ways)})"


# A repair ends in nothing (n), a system (s), a user (u) or an assistant turn (a); user and assistant turns
# may be put in before each turn and at the end (ui, ai).
_PUT_IN = f"""
    SELECT *, {_least("a", *_edited(["ui"], 3, "I", "'assistant:'"))} AS ai
    FROM (SELECT *, {_least("u", *_edited(["n", "s", "a"], 3, "I", "'user:'"))} AS ui FROM walk)"""
_SAYS = "role || ':' || said"
_FREE = "fault NOT IN (1, 2)"
_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
numbered AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(
        regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
          || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM numbered WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(said), copy) AS i,
    regexp_extract(said, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final
  FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS ch, CASE WHEN NOT regexp_matches(said, '[^\\x20\\x09-\\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, said ORDER BY i) > 1 THEN 2
      WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM placed),
walk(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), struct_pack(c := CAST(0 AS BIGINT), a := '', t := ''),
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)),
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) FROM judged
  UNION ALL
  SELECT w.conv_id, w.i + 1,
    {_edit("n", 4, "D")},
    {_least(*_edited(["s"], 4, "D", None), *_edited(["n"], "extra", "K", _SAYS, f"{_FREE} AND ch = 's'"))},
    {_least(*_edited(["ui"], 4, "D", None),
            *_edited(["n", "s", "ai"], "extra", "K", _SAYS, f"{_FREE} AND ch = 'u'"),
            *_edited(["n", "s", "ai"], "extra + 3", "R", "'user:' || said", _FREE))},
    {_least(*_edited(["ai"], 4, "D", None),
            *_edited(["ui"], "extra", "K", _SAYS, f"{_FREE} AND ch = 'a'"),
            *_edited(["ui"], "extra + 3", "R", "'assistant:' || said", _FREE))}
  FROM ({_PUT_IN}) AS w
  JOIN (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM judged) AS j
    ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1),
ended AS (
  SELECT conv_id, least(n, ai) AS best FROM ({_PUT_IN})
  QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
followed AS (
  SELECT *, lag(ch) OVER (PARTITION BY conv_id ORDER BY i) || ch AS pair FROM judged),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM followed GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(substring(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

ORACLE = {
    "op13_conversation_repair": _REPAIR,
    "op6_sharding": _SHARDS,
    "op8_suffix_dedup": _REPEATS,
    "op11_mixing": _MIX,
    "op12_lexical_search": _SEARCH,
}
