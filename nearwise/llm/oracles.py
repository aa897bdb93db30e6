"""The queries of this subpackage that SQL can express, as SQL for another engine."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

# The unsigned crc32 of a text x: a CTE of the table of bytes, and the loop over the text.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) t
  FROM (SELECT unnest(range(256)) b))"""


def crc32(text: str) -> str:
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), {step}), 4294967295)"


def _row_digest(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


def _tree(name: str, leaves: str) -> str:
    """A recursive CTE ``name(tree, level, pos, node)`` over ``leaves(tree, pos, node)``."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, node FROM {leaves}
  UNION ALL
  SELECT tree, min(level) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) n FROM {name}) WHERE n > 1 GROUP BY tree, pos // 3)"""


HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}')"

ORACLES = {
    "op1_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({LOWERED}, {ALPHANUMERIC}) w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, {ALPHANUMERIC}) w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') s
  FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) t(i) WHERE len(w) > 0),
windows AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') s
  FROM d, (SELECT DISTINCT k FROM tests), unnest(generate_series(1, len(w) - k + 1)) t(i)),
hits AS (SELECT r, i, k, item_id FROM windows JOIN tests USING (k, s)),
words AS (SELECT r, count(DISTINCT pos) n FROM hits, unnest(generate_series(i, i + k - 1)) t(pos) GROUP BY r),
items AS (
  SELECT r, count(*) n, string_agg(item, ',' ORDER BY item) ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(words.n, 0) AS BIGINT) n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op3_passages": f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) s FROM d, unnest(generate_series(1, len(w) - 34)) t(i)),
repeated AS (SELECT r, i FROM windows JOIN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT DISTINCT r, pos FROM repeated, unnest(generate_series(i, i + 34)) t(pos)),
words AS (SELECT r, pos, w[pos] word FROM d, unnest(generate_series(1, len(w))) t(pos)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) s FROM words ANTI JOIN gone USING (r, pos) GROUP BY r),
removed AS (SELECT r, count(*) n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(s, '')) kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)""",
    "op7_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({LOWERED}, {SPACED}) w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 1], ' ') x
  FROM d, unnest(generate_series(1, greatest(len(w) - 1, least(len(w), 1)))) t(i)),
n AS (SELECT r, count(*) n FROM s GROUP BY r),
sized AS (SELECT r, x, n FROM s JOIN n USING (r)),
links AS (
  SELECT a.r u, b.r v FROM sized a JOIN sized b ON a.x = b.x AND a.r <> b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, v FROM reach JOIN links ON u = q),
named AS (SELECT reach.r, min(other.doc_id) component_id FROM reach JOIN d other ON other.r = q GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, component_id, doc_id = component_id kept
FROM d JOIN named USING (r) LEFT JOIN n USING (r)""",
    "op11_manifest": f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT row_number() OVER () r, doc_id, source tree, {_row_digest('text')} leaf,
    {crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 tampered, {_row_digest("replace(text, chr(10), '')")} cut
  FROM documents, crc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 pos FROM d),
leaves AS (SELECT tree, pos, leaf node FROM ranked),
{_tree('groups', 'leaves')},
tops AS (SELECT tree, max_by(node, level) node, max(level) height FROM groups GROUP BY tree),
subroots AS (
  SELECT 'all' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 pos, node, tree AS source FROM tops),
{_tree('top', 'subroots')},
root AS (SELECT max_by(node, level) root, max(level) height FROM top),
steps AS (
  SELECT ranked.r, level, groups.pos, groups.node, ranked.pos // CAST(pow(3, level) AS BIGINT) own
  FROM ranked JOIN groups ON groups.tree IS NOT DISTINCT FROM ranked.tree JOIN tops ON tops.tree IS NOT DISTINCT FROM ranked.tree
  WHERE level < tops.height AND groups.pos // 3 = ranked.pos // CAST(pow(3, level + 1) AS BIGINT)
  UNION ALL
  SELECT ranked.r, tops.height + level, top.pos, top.node, subroots.pos // CAST(pow(3, level) AS BIGINT)
  FROM ranked JOIN tops ON tops.tree IS NOT DISTINCT FROM ranked.tree
    JOIN subroots ON subroots.source IS NOT DISTINCT FROM ranked.tree, top, root
  WHERE level < root.height AND top.pos // 3 = subroots.pos // CAST(pow(3, level + 1) AS BIGINT)),
runs AS (
  SELECT r, level, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < own), '') l,
    coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > own), '') g FROM steps GROUP BY r, level),
fold AS (
  SELECT r, 0 AS level, CASE WHEN tampered AND text_differs THEN cut ELSE leaf END node
  FROM (SELECT *, cut <> leaf text_differs FROM d)
  UNION ALL
  SELECT r, level + 1, sha256(l || node || g) FROM fold JOIN runs USING (r, level)),
folded AS (SELECT r, max_by(node, level) node FROM fold GROUP BY r),
proof AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY level)) s FROM runs GROUP BY r)
SELECT doc_id, leaf, tops.node subroot, root, coalesce(s, sha256('')) proof_sha256, folded.node folded_root, folded.node = root verified
FROM d JOIN tops ON tops.tree IS NOT DISTINCT FROM d.tree JOIN folded USING (r) LEFT JOIN proof USING (r), root""",
    "op12_prefix_trie": f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) l,
    {crc32('CAST(conv_id AS VARCHAR)')} % 4 h
  FROM conversations, crc WHERE conv_id IS NOT NULL GROUP BY conv_id, t),
rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(base.l[1 : own.h], []), own.l[own.h + 1 :]) l
  FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 20),
prefixes AS (SELECT conv_id, d, l[1 : d] k, len(l) = d ends FROM rebuilt, unnest(generate_series(0, len(l))) t(d)),
nodes AS (
  SELECT d, k, min(conv_id) conv_id, count(*) n,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') ids
  FROM prefixes GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1 : d - 1] k, count(*) n FROM nodes WHERE d > 0 GROUP BY ALL),
told AS (
  SELECT nodes.*, coalesce(kids.n, 0) n_children,
    CASE WHEN nodes.d = 0 THEN 0 ELSE (nodes.n - 1) * len(regexp_extract_all(nodes.k[nodes.d].text, {SPACED})) END own
  FROM nodes LEFT JOIN kids USING (d, k)),
sums AS (
  SELECT a AS d, k[1 : a] k, count(*) FILTER (n_children = 0) n_leaves, sum(own) saved
  FROM told, unnest(generate_series(0, d)) t(a) GROUP BY ALL)
SELECT told.conv_id, told.d AS depth, above.conv_id parent_conv_id, told.n n_convs, told.n_children, n_leaves,
  CAST(saved AS BIGINT) saved_tokens, sha256(told.ids) ends_sha256
FROM told JOIN sums USING (d, k) LEFT JOIN nodes above ON above.d = told.d - 1 AND above.k = told.k[1 : told.d - 1]""",
    "op13_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (
  SELECT page_id, {HOST} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_.*|ref|fbclid|gclid)(=|$)'))) q
  FROM p),
c AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END canonical
  FROM h),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])(adult|casino|pills|spam)([.-]|$)')),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END rule
  FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END verdict
FROM ruled""",
}
