"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from brevia.llm import bpe, chunks, jaccard, manifest, minmax, mixing, neighbours, quality, search, secrets, suffixes, toxicity, urls

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_chunk_dedup": chunks.op3_chunk_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_repeated_strings": suffixes.op6_repeated_strings,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_url_filter": urls.op8_url_filter,
    "op9_shingle_join": jaccard.op9_shingle_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_minmax_dedup": minmax.op13_minmax_dedup,
}


def _host(url: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{upper.lower()}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _node(url: str) -> str:
    rest = f"regexp_extract({url}, '^.*?://[^/?#]*([^#]*)', 1, 's')"
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || CASE WHEN starts_with({rest}, '/') THEN '' ELSE '/' END || {rest} END"


def _ruled(host: str, path: str, what: str) -> str:
    found = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v if what == 'verdict' else h + p}'" for v, h, p in found)
    return f"(CASE {cases} END)"


def _tags(name: str, has: str, link: str) -> str:
    """Links of the tags of a name that have an attribute; (url, link)."""
    tags = rf"SELECT url, unnest(regexp_extract_all(html, '(?is)<{name}\b[^>]*')) AS tag FROM pages"
    return f"SELECT url, regexp_extract(tag, '{link}', 1, 'is') AS link FROM ({tags}) WHERE regexp_matches(tag, '{has}', 'is')"


# \x27 is a single quote
_CANONICAL = r"\brel\s*=\s*[\"\x27]?canonical\b", r"\bhref\s*=\s*[\"\x27]?([^\"\x27\s>]+)"
_REFRESH = r"\bhttp-equiv\s*=\s*[\"\x27]?refresh\b", r"\bcontent\s*=\s*[\"\x27]?[^\"\x27>]*?url\s*=\s*[\"\x27]?([^\"\x27\s>]+)"
_URL_FILTER = f"""
WITH RECURSIVE links AS (
  {_tags("link", *_CANONICAL)} UNION ALL {_tags("meta", *_REFRESH)}
), found AS (
  SELECT *, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS base, regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1, 's') AS folder FROM links WHERE link <> ''
), whole AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN base || link
    WHEN ends_with(folder, '/') THEN folder || link ELSE folder || '/' || link END AS target FROM found
), named AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM whole
), edges AS (SELECT a, b FROM named WHERE a <> b UNION SELECT b, a FROM named WHERE a <> b
), reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
), seen AS (SELECT node, {_ruled(_host("'http://' || other"), _path("'http://' || other"), "verdict")} AS verdict FROM (SELECT node, other FROM reach UNION SELECT node, node FROM reach)
), fate AS (SELECT node, bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false) AS blocked FROM seen GROUP BY node
), p AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages)
SELECT page_id, host, path, {_ruled("host", "path", "rule")} AS rule, coalesce({_ruled("host", "path", "verdict")}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fate USING (node)
"""



def _similar(num: int, more: str = "") -> str:
    """Components of documents whose sets of three-word shingles have a similarity of num / 100 or more."""
    return _SHINGLE_JOIN.replace("{num}", str(num)).replace("{more}", more)


_SHINGLE_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= {num} * (na.n + nb.n - shared)
), reach AS (SELECT a AS node, b AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a
), lowest AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(lowest.other, w.doc_id)) AS component_id{more} FROM w LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON lowest.node = w.doc_id
"""

#: Bytes are two hexadecimal digits each, so that strings of 50 bytes are 100 digits; they are cut from pieces, as cutting from long texts takes long.
_REPEATED_STRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, sha256(encode(coalesce(text, ''))) AS whole FROM documents
), pieces AS (SELECT doc_id, 1000 * j AS base, substr(x, 2000 * j + 1, 2098) AS part FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 - 50) // 1000 + 1)) AS j FROM d WHERE len(x) >= 100)
), starts AS (SELECT doc_id, base + i AS i, substr(part, 2 * i + 1, 100) AS s FROM (SELECT doc_id, base, part, unnest(range(0, len(part) // 2 - 49)) AS i FROM pieces)
), lowest AS (SELECT s, min(doc_id) AS low FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT doc_id, i FROM starts JOIN lowest USING (s) WHERE low < doc_id
), fresh AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS f FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM fresh) GROUP BY doc_id, k
), gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans
), kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS left_over FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_spans IS NULL THEN whole ELSE sha256(unhex(left_over)) END AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    pow((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656,
      1 / coalesce(greatest(pow(length(translate(text, '#*$%&|<>', ''))::DOUBLE / greatest(length(text), 1), 2), 0.1), 0.1)) AS key FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT *, [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (SELECT *, least(cap, coalesce(max(CASE WHEN level < cap / w THEN level END) OVER () * w, cap)) AS target FROM l
), r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest FROM t
), k AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents
), whole AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d
), tf AS (SELECT doc_id, len(terms) AS n, term, count(*) AS tf FROM d, unnest(terms) AS u(term) GROUP BY ALL
), weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
), asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


#: The checksum of decimal digits, bit by bit; its last bit is turned in the end.
_CRC32 = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda a, c: list_reduce(range(8)::UBIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)), 4294967295::UBIGINT), 4294967295)"
#: The level above a list of nodes.
_ABOVE = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))"
_MERKLE_MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS now FROM documents
), trees AS (SELECT source, 0 AS level, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS nodes FROM d GROUP BY source
  UNION ALL SELECT source, level + 1, {_ABOVE} FROM trees WHERE len(nodes) > 1
), subroots AS (SELECT source, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1
), whole AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots UNION ALL SELECT level + 1, {_ABOVE} FROM whole WHERE len(nodes) > 1
), roots AS (SELECT nodes[1] AS root, level AS levels FROM whole WHERE len(nodes) = 1
), ranks AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, row_number() OVER () AS k FROM d
), start AS (SELECT k, rank, now, subroot, height, place, root, levels FROM ranks, subroots, roots WHERE ranks.source IS NOT DISTINCT FROM subroots.source
), steps AS (
  SELECT k, level, nodes, rank // (3 ** level)::BIGINT AS i FROM ranks, trees WHERE ranks.source IS NOT DISTINCT FROM trees.source AND len(nodes) > 1
  UNION ALL SELECT k, height + level, nodes, place // (3 ** level)::BIGINT FROM start, whole WHERE len(nodes) > 1
), siblings AS (SELECT k, level, array_to_string(nodes[i - i % 3 + 1 : i], '') AS l, array_to_string(nodes[i + 2 : i - i % 3 + 3], '') AS r FROM steps
), proofs AS (SELECT k, string_agg(l || r, '' ORDER BY level) AS proof FROM siblings GROUP BY k
), fold AS (SELECT k, 0 AS level, now AS node FROM ranks UNION ALL SELECT k, level + 1, sha256(l || node || r) FROM fold JOIN siblings USING (k, level)
), ends AS (SELECT k, max_by(node, level) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranks JOIN start USING (k) JOIN ends USING (k) LEFT JOIN proofs USING (k)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": _SOURCE_MIX,
    "op6_repeated_strings": _REPEATED_STRINGS,
    "op8_url_filter": _URL_FILTER,
    "op9_shingle_join": _similar(90),
    "op11_ranked_search": _RANKED_SEARCH,
    "op12_merkle_manifest": _MERKLE_MANIFEST,
    "op13_minmax_dedup": _similar(85, ", w.doc_id = component_id AS kept"),
}
