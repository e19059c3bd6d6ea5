"""DuckDB SQL that returns the rows of the registered queries."""

CONTROLS = ["</s>", "<s>", "[/INST]", "[/ROLE]", "[INST]", "[ROLE]", "[TURN]"]


def _escaped(text: str) -> str:
    sql = f"replace({text}, '␛', '␛␛')"
    for x in CONTROLS:
        sql = f"replace({sql}, '{x}', '{x[0]}␛{x[1:]}')"
    return sql


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
), marked AS (
  SELECT *, {_escaped("text")} AS body, {_escaped("role")} AS head,
    coalesce(lag(role) OVER w <> role, true) AS begins
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- <s>[ROLE] role [/ROLE] ... </s> per block, [TURN] before each further turn of a block
  sum(length(body) + CASE WHEN begins THEN 9 + length(head) + 7 + 4 ELSE 6 END)::BIGINT AS formatted_chars,
  (count(*) FILTER (begins))::BIGINT AS n_blocks
FROM marked GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to, true AS complete
FROM p LEFT JOIN g ON p.digest = g.digest AND n >= 1000
"""

# Jump consistent hash for 40 and 41 shards, and CRC-32 (polynomial 0xEDB88320) by nibbles.
_JUMP = """
list_reduce(list_prepend({{'k': doc_id::HUGEINT + (doc_id < 0)::INT * 18446744073709551616::HUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}},
  list_transform(range({n}), lambda i: {{'k': 0::HUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}})),
  lambda a, x: CASE WHEN a.j >= {n} THEN a ELSE {{
    'k': (a.k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT,
    'b': a.j,
    'j': floor((a.j + 1)::DOUBLE * (2147483648::DOUBLE / (((a.k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT) // 8589934592 + 1)::DOUBLE))::BIGINT}} END).b::INTEGER
"""
_NIBBLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_STEP = f"xor(c >> 4, {_NIBBLE}[(c & 15) + 1])"
SHARDING = f"""
WITH h AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), crc AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda a, b: xor(xor(xor(a, b) >> 4, {_NIBBLE}[(xor(a, b) & 15) + 1]) >> 4, {_NIBBLE}[(xor(xor(a, b) >> 4, {_NIBBLE}[(xor(a, b) & 15) + 1]) & 15) + 1])
  ), 4294967295) AS text_crc32 FROM h
), s AS (SELECT *, {_JUMP.format(n=40)} AS shard, {_JUMP.format(n=41)} AS grown_shard FROM crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, text_crc32, size)), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM s
"""

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format(t="text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) r(i)
), found AS (SELECT doc_id, i, g.n AS n, item_id FROM grams g JOIN windows USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) r(p) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents JOIN n USING (doc_id)),
t AS (SELECT s.* FROM s JOIN same ON s.doc_id = same.doc_id AND same.doc_id = same.rep),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)
  UNION ALL SELECT rep, doc_id FROM same WHERE rep < doc_id
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON d.doc_id = r.a GROUP BY d.doc_id, n.n
"""

# What SQL can say of the mixture: sizes and targets.  The drawn copies are held against expectations by tests.
MIXING = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
-- The level at which targets sum to the total, if the sources up to a ratio of size and weight are full.
l AS (SELECT *, sum(source_size) OVER () AS total, source_size / w AS ratio, coalesce(sum(source_size) OVER o, 0) AS full_size, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_weight
  FROM s WINDOW o AS (ORDER BY source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT arg_min((total - 3 * full_size) / open_weight, ratio) AS level FROM l WHERE (total - 3 * full_size) / open_weight * w <= 3 * source_size)
SELECT doc_id, size, source_size, least(3.0 * source_size, level * w)::DOUBLE AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN t
"""

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format(t="text")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
-- every group and every language with every kept term
counts AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, total FROM (SELECT DISTINCT lang, source FROM d) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (sum(n) OVER l + count(*) OVER g) AS q
  FROM counts WINDOW g AS (PARTITION BY lang, source), l AS (PARTITION BY lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tops AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM every UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM tops
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS "rank" FROM ranked QUALIFY part = 'pair' OR "rank" <= 200
"""


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(({x})::VARCHAR))::VARCHAR || ':' || ({x})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# Siblings are marked L or R by their side; S stands for a run of one node.
MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(xor(xor(a, b) >> 4, {_NIBBLE}[(xor(a, b) & 15) + 1]) >> 4, {_NIBBLE}[(xor(xor(a, b) >> 4, {_NIBBLE}[(xor(a, b) & 15) + 1]) & 15) + 1])), 4294967295) % 7 = 0
    THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS shown
  FROM documents
), leaves AS (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM docs
), tree(g, level, idx, n, hash) AS (
  SELECT g, 0, idx, n, leaf FROM leaves
  UNION ALL SELECT g, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY g, level, idx // 2
), subroots AS (
  SELECT g, hash AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), high(level, idx, n, hash) AS (
  SELECT 0, idx, n, subroot FROM subroots
  UNION ALL SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
  SELECT l.g, l.idx, t.level, CASE WHEN o.hash IS NULL THEN 'S' WHEN o.idx < t.idx THEN 'L' ELSE 'R' END AS side, coalesce(o.hash, '') AS hash
  FROM leaves l JOIN tree t ON t.g = l.g AND t.idx = l.idx >> t.level AND t.n > 1 LEFT JOIN tree o ON o.g = t.g AND o.level = t.level AND o.idx = xor(t.idx, 1)
), rest AS (
  SELECT s.g, t.level, CASE WHEN o.hash IS NULL THEN 'S' WHEN o.idx < t.idx THEN 'L' ELSE 'R' END AS side, coalesce(o.hash, '') AS hash
  FROM subroots s JOIN high t ON t.idx = s.idx >> t.level AND t.n > 1 LEFT JOIN high o ON o.level = t.level AND o.idx = xor(t.idx, 1)
), paths AS (SELECT g, idx, list(side || hash ORDER BY level) AS path FROM steps GROUP BY ALL),
ends AS (SELECT g, list(side || hash ORDER BY level) AS path FROM rest GROUP BY 1),
whole AS (
  SELECT l.*, subroot, (SELECT hash FROM high WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(e.path, [])) AS path
  FROM leaves l JOIN subroots USING (g) LEFT JOIN paths p ON p.g = l.g AND p.idx = l.idx LEFT JOIN ends e ON e.g = l.g
), folded AS (
  SELECT *, list_reduce(list_prepend(shown, path), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
