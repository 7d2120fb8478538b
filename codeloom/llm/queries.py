"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op7_decontamination
from .filter_audit import op12_filter_audit
from .html_text import op5_html_text
from .imatch import op8_imatch
from .lm_score import op6_lm_score
from .merkle import op11_merkle_manifest
from .minhash import op3_minhash_dedup
from .packing import op9_best_fit_packing
from .token_counts import op10_token_counts
from .token_output import op1_token_output
from .toxicity import op2_toxicity
from .url_filter import op4_url_filter
from .warc import op13_warc_bundles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_output": op1_token_output,
        "op2_toxicity": op2_toxicity,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_html_text": op5_html_text,
        "op6_lm_score": op6_lm_score,
        "op7_decontamination": op7_decontamination,
        "op8_imatch": op8_imatch,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_token_counts": op10_token_counts,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_filter_audit": op12_filter_audit,
        "op13_warc_bundles": op13_warc_bundles,
    }


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingles and links of all pairs that share one, and what is reached over links
DEDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
 least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""

_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: All windows of items, all runs of documents that are as long, and the words under those that agree
LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT coalesce(item_id, '') AS item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x FROM b),
 places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
 occ AS (SELECT doc_id, i, p.k, item_id FROM places p JOIN win ON win.k = p.k AND win.x = array_to_string(w[i:i + p.k - 1], ' ')),
 hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM occ) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _field(value: str, text: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text} END"


_DECIMAL = "CAST(doc_id AS VARCHAR)"
_BITS = "list_reduce(list_prepend(xor(c, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))"
#: Unsigned CRC-32 of a decimal number's digits, bit by bit
CRC32 = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({_DECIMAL}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {_BITS}))"


def _leaf(text: str) -> str:
    fields = [("doc_id", _DECIMAL), ("source", "source"), ("lang", "lang"), ("n_chars", "CAST(n_chars AS VARCHAR)"), ("text", text)]
    return f"sha256({' || '.join(_field(v, t) for v, t in fields)})"


def _climb(name: str, start: str) -> str:
    """All nodes of all trees, by recursion, and what stands before and after each node in its run."""
    return f"""{name} AS ({start} UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16),
 {name}_runs AS (SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS digests FROM {name} WHERE n > 1 GROUP BY 1, 2, 3),
 {name}_steps AS (SELECT a.tree, a.level, a.pos, array_to_string(digests[1:a.pos % 16], '') AS before, array_to_string(digests[a.pos % 16 + 2:], '') AS after FROM {name} a JOIN {name}_runs r ON a.tree = r.tree AND a.level = r.level AND a.pos // 16 = r.run)"""


def _fold(name: str, start: str, over: str) -> str:
    return f"""{name} AS ({start} UNION ALL SELECT f.doc_id, f.tree, f.level + 1, f.pos // 16, sha256(before || digest || after), proof || before || after FROM {name} f JOIN {over}_steps s ON f.tree = s.tree AND f.level = s.level AND f.pos = s.pos),
 {name}_end AS (SELECT doc_id, tree, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM {name} GROUP BY 1, 2)"""


MERKLE = f"""WITH RECURSIVE leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  {_leaf('text')} AS leaf, CASE WHEN {CRC32} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS changed FROM documents),
 {_climb('low', 'SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves')},
 tops AS (SELECT tree, arg_max(digest, level) AS subroot FROM low WHERE n = 1 GROUP BY 1),
 {_climb('high', 'SELECT 0::BIGINT AS tree, 0 AS level, tree AS pos, subroot AS digest, (SELECT count(*) FROM tops) AS n FROM tops')},
 {_fold('inner_fold', "SELECT doc_id, tree, 0 AS level, pos, changed AS digest, '' AS proof FROM leaves", 'low')},
 {_fold('outer_fold', 'SELECT doc_id, 0::BIGINT AS tree, 0 AS level, tree AS pos, digest, proof FROM inner_fold_end', 'high')}
 SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
 FROM leaves JOIN tops USING (tree) JOIN (SELECT arg_max(digest, level) AS root FROM high WHERE n = 1) ON true JOIN (SELECT doc_id, digest, proof FROM outer_fold_end) USING (doc_id)"""

#: Every document through every order of the filters, one after the other
AUDIT = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
 f AS (SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
   || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
   || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed FROM d),
 g AS (SELECT part, failed, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM f LEFT JOIN labels l USING (doc_id)),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 orders AS (SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders JOIN letters ON NOT contains(o, x)),
 steps AS (SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM orders JOIN (SELECT unnest(range(1, 6)) AS step) ON length(o) = 5),
 seen AS (SELECT part, o, step, x, failed, good, toxic, contains(failed, x) AS fails, length(translate(before, failed, '')) < length(before) AS gone FROM g JOIN steps ON true),
 counted AS (SELECT part, o, step, x, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed, count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (failed = x) AS unique_fails,
   count(*) FILTER (NOT gone AND fails AND good) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic) AS toxic_lost FROM seen GROUP BY 1, 2, 3, 4)
 SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted"""

ARCHIVE = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose results it can express. The others depend on a trained model, on a tokenizer's merges, on hashes
    or on a parser, and are held against brute force in tests/llm."""
    return {"op3_minhash_dedup": DEDUP, "op7_decontamination": LEAKS, "op11_merkle_manifest": MERKLE, "op12_filter_audit": AUDIT, "op13_warc_bundles": ARCHIVE}
