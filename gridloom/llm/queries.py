"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import quality
from .bpe import bpe_decode, bpe_encode
from .dialogue import damaged, dialogue_repair
from .licenses import TEMPLATES, bigrams, license_scan, normalised
from .lines import dedup_lines
from .minhash import near_duplicates
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .pii import pseudonymise
from .quality import quality_rules
from .repair import encode_to_files
from .sharding import shard_documents
from .shared import table
from .toxicity import toxicity
from .trie import prefix_trie, rebuilt

#: The vocabulary file of the queries; it stands at the same path on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), TOKENIZER)
    return bpe_decode(encoded, TOKENIZER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, window=2048, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = encode_to_files(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_license_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.col("n_notices").cast("long").alias("n_notices"), F.round("best_dice", 6).alias("best_dice"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations"), block=20))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return dialogue_repair(conversations, damaged(conversations))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = [
    op1_minhash_near_dedup,
    op2_karmarkar_karp_sharding,
    op3_divergence_quality,
    op4_boosted_toxicity,
    op5_bpe_round_trip,
    op6_learned_partitions,
    op7_feistel_pseudonyms,
    op8_bm25_packing,
    op9_repair_files,
    op10_license_bigrams,
    op11_prefix_trie,
    op12_dialogue_repair,
    op13_line_dedup,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op1_sql() -> str:
    return f"""WITH RECURSIVE split AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, d.component_id, d.doc_id = d.component_id AS kept
    FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) d LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


def _op3_sql() -> str:
    gap, symbols = r"[\x20\x09-\x0D]", quality._SYMBOLS.decode()
    kinds = {"lower": r"\p{Ll}\p{Lo}\p{Lm}\p{Mn}\p{Mc}", "upper": r"\p{Lu}\p{Lt}", "digit": r"\p{Nd}\p{Nl}\p{No}", "space": r"\p{Zs}\p{Zl}\p{Zp}\x09-\x0D"}
    count = {k: f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for k, c in kinds.items()}
    count["point"] = f"length(regexp_replace(regexp_replace(t, '[{symbols}]', '', 'g'), '[^\\p{{P}}]', '', 'g'))"
    count["symbol"] = f"length(regexp_replace(t, '[^\\p{{S}}{symbols}]', '', 'g'))"
    count["other"] = f"length(t) - {' - '.join(f'({c})' for c in count.values())}"
    assert tuple(count) == quality.CLASSES

    def term(p: str, q: str) -> str:
        return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"

    def distance(parts: str) -> str:
        return f"sqrt(least(1, greatest(0, ({parts}) / 2)))"

    class_terms = " + ".join(term(f"(d.c[{k}] / d.points)", f"(e.c[{k}] / list_sum(e.c))") for k in range(1, len(count) + 1))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract(lower(coalesce(lang, '')), '{quality.LANGUAGE}', 1) AS lang, t, length(t)::DOUBLE AS points,
            list_filter(string_split_regex(t, '{gap}+'), lambda x: x <> '') AS w, [{', '.join(f'({c})::DOUBLE' for c in count.values())}] AS c
        FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
    u AS MATERIALIZED (SELECT r, lang, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
    three AS (SELECT r, k, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY r ORDER BY k)),
    twice AS (SELECT r, k FROM three WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY 1),
    lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
    base AS MATERIALIZED (SELECT d.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
            length(regexp_replace(t, '[^{symbols}]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
            len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN lines ON lines.r = d.r LEFT JOIN repeats ON repeats.r = d.r),
    totals AS (SELECT name, sum(n_words) AS size FROM (SELECT lang AS name, n_words FROM base) GROUP BY 1),
    classes AS (SELECT lang, {', '.join(f'sum(c[{k}]) AS c{k}' for k in range(1, len(count) + 1))} FROM base GROUP BY 1),
    refs AS MATERIALIZED (
        SELECT t.name, t.size, [{', '.join(f'c{k}' for k in range(1, len(count) + 1))}] AS c FROM totals t JOIN classes ON lang = t.name WHERE t.name <> '' AND t.size >= {quality.LANGUAGE_WORDS}
        UNION ALL SELECT '', 0, [{', '.join(f'sum(c{k})' for k in range(1, len(count) + 1))}] FROM classes HAVING {' + '.join(f'sum(c{k})' for k in range(1, len(count) + 1))} > 0),
    counted AS (SELECT lang AS name, x, count(*) AS n FROM u GROUP BY ALL),
    keys AS MATERIALIZED (SELECT name, x, n / size::DOUBLE AS q FROM counted JOIN refs USING (name) WHERE name <> '' AND n >= size * {quality.COMMON_SHARE}::DOUBLE),
    known AS (SELECT name, sum(q) AS q, count(*) AS n FROM keys GROUP BY 1),
    held AS (SELECT r, x, count(*) AS n FROM u GROUP BY ALL),
    met AS (SELECT r, name, sum(h.n) AS n, sum(k.q) AS q, sum({term('(h.n / b.n_words::DOUBLE)', 'k.q')}) AS js FROM held h JOIN base b USING (r) JOIN keys k ON k.x = h.x GROUP BY ALL),
    pairs AS (SELECT d.r, d.n_words, d.points, e.name, d.lang = e.name OR e.name = '' AS own, coalesce(met.js, 0) + coalesce(known.q, 0) - coalesce(met.q, 0) AS js,
            1 - coalesce(met.n, 0) / d.n_words::DOUBLE AS p, 1 - coalesce(known.q, 0) AS q, {distance(class_terms)} AS c
        FROM base d JOIN refs e ON e.name <> '' OR d.lang NOT IN (SELECT name FROM refs WHERE name <> '') LEFT JOIN known ON known.name = e.name LEFT JOIN met ON met.r = d.r AND met.name = e.name),
    near AS (SELECT r, own, CASE WHEN points >= {quality.MIN_CHARS} THEN c END AS c, CASE WHEN n_words >= {quality.MIN_WORDS} AND name <> '' THEN {distance(f"js + {term('p', 'q')}")} END AS w FROM pairs),
    best AS (SELECT r, coalesce(max(c) FILTER (own), -1) AS c, coalesce(max(w) FILTER (own), -1) AS w,
            bool_or(coalesce(c, 0) <= {quality.MAX_CLASS_DISTANCE} AND CASE WHEN own THEN coalesce(w, 0) <= {quality.MAX_WORD_DISTANCE} ELSE coalesce(w, 1) <= {quality.OTHER_WORD_DISTANCE} END) AS fits FROM near GROUP BY 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(CASE WHEN best.c >= 0 THEN best.c END, 6) AS class_distance,
        round(CASE WHEN best.w >= 0 THEN best.w END, 6) AS word_distance, NOT base_failed AND coalesce(fits, true) AS kept
    FROM base LEFT JOIN best ON best.r = base.r"""


def _op10_sql() -> str:
    rows = sorted({(name, tuple(sorted(bigrams(normalised(text))))) for name, text in TEMPLATES})
    listed = ", ".join(f"('{name}', [{', '.join(repr(p) for p in pairs)}])" for name, pairs in rows)
    return f"""WITH templates(name, pairs) AS (VALUES {listed}),
    parts AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?:;])\\s+', '\\1\n', 'g'), '[\\n\\r]+')) AS part FROM documents),
    words AS (SELECT doc_id, row_number() OVER () AS i, string_split(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM parts),
    pairs AS (SELECT doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS p FROM words WHERE len(w) > 1),
    dice AS (SELECT doc_id, i, name, 2.0 * len(list_intersect(p, pairs.pairs)) / (len(p) + len(pairs.pairs)) AS d FROM (SELECT q.*, t.* FROM pairs q, templates t) pairs),
    best AS (SELECT * FROM dice WHERE d >= 0.8 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d DESC, name) = 1)
    SELECT d.doc_id, coalesce(string_agg(DISTINCT b.name, ',' ORDER BY b.name), '') AS licenses, count(b.i) AS n_notices, round(max(b.d), 6) AS best_dice
    FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id GROUP BY 1"""


#: CRC-32 of the ASCII text s, given ``crc(t)``, the list of the table's 256 entries.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(s: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295)"


_OP11_SQL = f"""WITH {_CRC_TABLE},
    placed AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY 1),
    plan AS MATERIALIZED (SELECT s.conv_id, {_crc("s.conv_id::VARCHAR")} % 4 AS h, s.conv_id - s.conv_id % 20 AS donor, coalesce(d.n, 0) AS donor_n
        FROM sizes s LEFT JOIN sizes d ON d.conv_id = s.conv_id - s.conv_id % 20, crc),
    turns AS (SELECT plan.conv_id, pos AS depth, role, text FROM plan JOIN placed ON placed.conv_id = donor WHERE pos <= h
        UNION ALL SELECT conv_id, least(h, donor_n) + pos - h, role, text FROM plan JOIN placed USING (conv_id) WHERE pos > h),
    members AS MATERIALIZED (SELECT conv_id, depth, md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
            len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM turns
        UNION ALL SELECT conv_id, 0, '', 0 FROM sizes),
    nodes AS MATERIALIZED (SELECT depth, key, min(conv_id) AS c, count(*) AS n_convs, max(words) AS words FROM members GROUP BY 1, 2),
    above AS MATERIALIZED (SELECT n.c, n.depth, a.c AS ac, a.depth AS ad, (n.n_convs - 1) * n.words AS saved FROM nodes n JOIN members m ON m.conv_id = n.c AND m.depth <= n.depth JOIN nodes a ON a.depth = m.depth AND a.key = m.key),
    kids AS (SELECT ac AS c, ad AS depth, count(*) AS n FROM above WHERE ad = depth - 1 GROUP BY ALL),
    sums AS (SELECT ac AS c, ad AS depth, sum(saved)::BIGINT AS saved, count(*) FILTER (n IS NULL) AS leaves FROM above LEFT JOIN kids ON kids.c = above.c AND kids.depth = above.depth GROUP BY ALL),
    ends AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM members WHERE (conv_id, depth) IN (SELECT conv_id, max(depth) FROM members GROUP BY 1) GROUP BY 1, 2)
    SELECT n.c AS conv_id, n.depth, p.ac AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, sums.saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes n JOIN sums ON sums.c = n.c AND sums.depth = n.depth LEFT JOIN kids ON kids.c = n.c AND kids.depth = n.depth
    LEFT JOIN above p ON p.c = n.c AND p.depth = n.depth AND p.ad = n.depth - 1 LEFT JOIN ends ON ends.depth = n.depth AND ends.key = n.key"""


def _op12_sql() -> str:
    def turn(role: str, by: int, after: str) -> str:
        return f"{{'c': {after}.c + {by}, 'a': 'I' || {after}.a, 't': ['{role}:'] || {after}.t}}"

    def row(letter: str, by: str, line: str, after: str) -> str:
        return f"{{'c': {after}.c + {by}, 'a': '{letter}' || {after}.a, 't': {f'[{line}] || ' if line else ''}{after}.t}}"

    def least(options: list[str]) -> str:
        return f"list_sort([x for x in [{', '.join(options)}] if x is not null])[1]"

    roles, goes = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    direct = []
    for q in range(4):
        kept = "".join(f" WHEN role[1] = '{i}' THEN {row('K', 'late', 'line', f'b{to}')}" for i, to in keeps[q].items())
        options = [row("D", "4", "", f"b{q}"), f"CASE WHEN gone THEN NULL{kept} END", f"CASE WHEN NOT gone THEN {row('R', '3 + late', f"'{roles[q]}:' || text", f'b{goes[q]}')} END"]
        direct.append(f"{least(options)} AS d{q}")
    closed = ", ".join(f"{least([f'd{q}', turn(roles[q], 3, f'd{goes[q]}'), turn(roles[q], 3, turn(roles[goes[q]], 3, f'd{goes[goes[q]]}').join('()'))])} AS b{q}" for q in range(4))
    end = ", ".join(f"{{'c': {c}::BIGINT, 'a': '{'I' * len(t)}', 't': {t}::VARCHAR[]}} AS b{q}" for q, (c, t) in enumerate([(0, []), (6, ["user:", "assistant:"]), (3, ["assistant:"]), (0, [])]))
    return f"""WITH RECURSIVE {_CRC_TABLE},
    kinds AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
    turns AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(role[1]) OVER w || role[1] AS pair FROM turns WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy)),
    faults AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
    rows AS MATERIALIZED (SELECT conv, pos, role, text, role || ':' || text AS line, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS late FROM faults),
    back AS (SELECT conv, max(pos) AS i, {end} FROM rows GROUP BY 1
        UNION ALL SELECT conv, i - 1, {closed} FROM (SELECT back.conv, i, {', '.join(direct)} FROM back JOIN rows ON rows.conv = back.conv AND rows.pos = i)),
    best AS (SELECT conv, b0 AS b FROM back WHERE i = 0),
    counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
    SELECT conv_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv = coalesce(conv_id::VARCHAR, ' ') LEFT JOIN best ON best.conv = coalesce(conv_id::VARCHAR, ' ')"""


_OP13_SQL = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS MATERIALIZED (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM docs),
    keyed AS MATERIALIZED (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM lines),
    common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT r) >= 10),
    kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM keyed WHERE k NOT IN (SELECT k FROM common) GROUP BY 1)
    SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are held against brute force or held-out labels in the tests."""
    return {"op1_minhash_near_dedup": _op1_sql(), "op3_divergence_quality": _op3_sql(), "op10_license_bigrams": _op10_sql(), "op11_prefix_trie": _OP11_SQL, "op12_dialogue_repair": _op12_sql(), "op13_line_dedup": _OP13_SQL}
