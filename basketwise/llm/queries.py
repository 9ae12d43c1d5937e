"""The operators as queries over the whole tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from basketwise.llm import (
    centroids,
    chat,
    decontamination,
    jaccard_join,
    licenses,
    packing,
    prefix_trie,
    quality,
    sharding,
    simple8b,
    token_rollup,
    topk,
    toxicity,
)
from basketwise.llm.text import table
from basketwise.llm.vectors import whole_vectors
from basketwise.session import ensure_checkpoint_dir, stage

REGISTERED = {}
ORACLES: dict[str, str] = {}

END_ID = 1
# A conversation whose texts are full of control strings.
PROBE = r"\### Assistant: </turn> ok"


def query(function):
    REGISTERED[function.__name__] = function
    return function


def _new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def op1_toxicity(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_simple8b(spark, folder):
    path = _new_folder(spark, "token-ids")
    simple8b.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    read = simple8b.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    judged = quality.with_verdict(docs, model).select("doc_id", "verdict.*")
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


@query
def op4_sharding(spark, folder):
    rows = sharding.shard(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op5_token_rollup(spark, folder):
    docs = table(spark, folder, "documents")
    store = token_rollup.RollupStore(spark, _new_folder(spark, "rollup"))
    tokenizers = {name: public_tokenizers.path(f"{name}.json") for name in ("word_bpe_49k", "byte_bpe_50k")}
    for name, changes in token_rollup.document_changes(docs, tokenizers).items():
        store.commit(name, changes)
        store.commit(name, changes)  # a repeated commit changes nothing
        if name == "load":
            store.compact()
    return store.totals()


@query
def op6_decontamination(spark, folder):
    return decontamination.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op8_jaccard_join(spark, folder):
    return jaccard_join.similarity_classes(table(spark, folder, "documents"))


@query
def op9_chat_windows(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    windows = stage(chat.format_windows(turns.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json")))
    return chat.read_back(windows)


@query
def op10_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


@query
def op11_top_k(spark, folder):
    return topk.best_matches(whole_vectors(table(spark, folder, "embeddings")), "vec_id % 20 = 0")


@query
def op12_centroids(spark, folder):
    return centroids.clusters_of(whole_vectors(table(spark, folder, "embeddings"), centroids.COMPONENTS))


@query
def op13_prefix_trie(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


# --- SQL -----------------------------------------------------------------------------

WORDS = r"[^\x20\x09-\x0D]+"
LOWER_WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"""
SHINGLES = """CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""

ORACLES["op6_decontamination"] = f"""
WITH d AS (SELECT doc_id, unnest({SHINGLES}) AS g FROM (SELECT doc_id, {LOWER_WORDS} AS w FROM documents)),
i AS (SELECT item_id, unnest({SHINGLES}) AS g FROM (SELECT item_id, {LOWER_WORDS} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared::BIGINT AS shared, item_shingles::BIGINT AS item_shingles
FROM s JOIN n USING (item_id) WHERE shared * 100 >= item_shingles * {decontamination.THRESHOLD}"""

ORACLES["op8_jaccard_join"] = f"""
WITH RECURSIVE sets AS (SELECT doc_id, {SHINGLES} AS g FROM (SELECT doc_id, {LOWER_WORDS} AS w FROM documents)),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.seen)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM sets
JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def _license_sql() -> str:
    """The scan with the same tables: both readings of a text, all rules, and lines with an SPDX tag."""
    sentences, rules = licenses.DEFAULT_SENTENCES, licenses.DEFAULT_RULES
    numbers = {name: k for k, name in enumerate(sentences, 1)}

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def number(sentence: str) -> str:
        whole = "[" + ", ".join(text(s) for s in sentences.values()) + "]"
        found = [f"list_position({whole}, {sentence})"]
        for k, known in enumerate(sentences.values(), 1):
            if "*" in known:
                words = ".*".join(part for part in known.split("*"))
                # One star stands for one character at least, more of them for any.
                words = f"^{words}$" if known.count("*") > 1 else f"^{words.replace('.*', '.+')}$"
                found.append(f"CASE WHEN regexp_matches({sentence}, {text(words)}) THEN {k} END")
        return f"coalesce({', '.join(found)})"

    plain = f"trim(regexp_replace({{}}, '{licenses.OTHER}', ' ', 'g'))"
    lines = f"list_transform(string_split(s, chr(10)), lambda l: {number(plain.format('l'))})"
    known_lines = f"list_filter({lines}, lambda n: n IS NOT NULL)"
    whole = f"list_filter([{number(plain.format('s'))}], lambda n: n IS NOT NULL)"

    def times(names) -> str:
        wanted = [numbers[name] for name in names]
        size, places = len(wanted), "[" + ", ".join(map(str, wanted)) + "]"
        back = f"n - n % {size} + (k = {wanted[0]})::BIGINT" if isinstance(names, tuple) else "n"
        step = f"CASE WHEN k = {places}[n % {size} + 1] THEN n + 1 ELSE {back} END"
        return f"(list_reduce(list_concat([0::BIGINT], ids), lambda n, k: {step}) // {size})"

    nested = {k: [j for j, (_, other) in enumerate(rules) if licenses.contained(names, other)] for k, (_, names) in enumerate(rules)}

    def own(chosen: list[int]) -> str:
        parts = []
        for j in chosen:
            inner = [i for i in nested[j] if i in chosen]
            parts.append(f"(t{j} - {own(inner)})" if inner else f"t{j}")
        return "(" + " + ".join(parts) + ")"

    found = []
    for k, (licence, _) in enumerate(rules):
        taken = f" - {own(nested[k])}" if any(rules[j][0] != licence for j in nested[k]) else ""
        found.append(f"CASE WHEN t{k}{taken} > 0 THEN {text(licence)} END")
    spelling = {licence.lower(): licence for licence, _ in rules} | {old.lower(): new for old, new in licenses.SPDX_OLD.items()}
    spelled = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in spelling.items()) + "}"
    line = r"regexp_replace(regexp_replace(l, '[()]', ' ', 'g'), '(?i)[ \t]+with[ \t]+[^ \t]+', ' ', 'g')"
    names = rf"list_filter(regexp_split_to_array({line}, '(?i)[ \t]+(?:and|or)[ \t]+|[ \t]+'), lambda x: x <> '')"
    tagged = f"flatten(list_transform(regexp_extract_all(text, '{licenses.SPDX_LINE}', 1), lambda l: {names}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, regexp_split_to_array(lower(text), '{licenses.PARAGRAPHS}') AS sentences FROM d),
read AS (SELECT doc_id, flatten(list_transform(sentences, lambda s: CASE WHEN contains(s, chr(10))
    THEN list_concat(list_filter({whole}, lambda n: NOT list_contains({known_lines}, n)), {known_lines}) ELSE {whole} END)) AS ids,
  CASE WHEN contains(lower(text), '{licenses.SPDX_TAG}')
    THEN list_transform({tagged}, lambda n: coalesce({spelled}[lower(n)], n)) ELSE [] END AS named FROM parts),
met AS (SELECT *, {', '.join(f'{times(rule)} AS t{k}' for k, (_, rule) in enumerate(rules))} FROM read)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, ',' || array_to_string(list_transform(ids, lambda n: n || ','), '') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_concat(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL), named))), ',') AS licenses
FROM met"""


ORACLES["op7_license_scan"] = _license_sql()


WHOLE_VECTORS = """SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLES["op11_top_k"] = f"""
WITH v AS ({WHOLE_VECTORS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {topk.BEST}"""


def _centroid_sql() -> str:
    """Three rounds and the last assignment, a component of a vector or centroid in each row."""
    nearest = """SELECT vec_id, min_by(k, d * 100 + k) AS k, min(d) AS d FROM (
  SELECT vec_id, k, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN {} c USING (i) GROUP BY vec_id, k) GROUP BY vec_id"""
    steps = [
        f"v AS (SELECT * FROM ({WHOLE_VECTORS}) WHERE len(e) = {centroids.COMPONENTS})",
        "x AS (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS v FROM v)",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM v
  ORDER BY sha256('1:' || vec_id) LIMIT {centroids.CLUSTERS})""",
        "c0 AS MATERIALIZED (SELECT k, i, v FROM first JOIN x USING (vec_id))",
    ]
    for step in range(centroids.ROUNDS):
        steps += [
            f"a{step} AS MATERIALIZED ({nearest.format(f'c{step}')})",
            f"""m{step} AS (SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS v
  FROM (SELECT k, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{step} JOIN x USING (vec_id) GROUP BY k, i))""",
            f"""c{step + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.v, c.v) AS v
  FROM c{step} c LEFT JOIN m{step} m ON c.k = m.k AND c.i = m.i)""",
        ]
    last = f"c{centroids.ROUNDS}"
    steps.append(f"a AS MATERIALIZED ({nearest.format(last)})")
    return f"""
WITH {', '.join(steps)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a JOIN (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM {last} GROUP BY k) USING (k)"""


ORACLES["op12_centroids"] = _centroid_sql()

# The crc32 of a decimal number, from a table of 256 remainders.
CRC_TABLE = """list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a >> 8, remainders[xor(a & 255, b) + 1])), 4294967295)"""

ORACLES["op13_prefix_trie"] = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
planned AS (SELECT conv_id, s, {CRC32} % {prefix_trie.MOST_SHARED + 1} AS h, conv_id - conv_id % {prefix_trie.FAMILY} AS base
  FROM own, (SELECT {CRC_TABLE} AS remainders)),
rebuilt AS (SELECT p.conv_id, list_concat(coalesce(b.s[1:p.h], []), p.s[p.h + 1:]) AS s
  FROM planned p LEFT JOIN own b ON b.conv_id = p.base),
prefixes AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
nodes AS (SELECT s[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CASE WHEN len(s) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY s[1:depth], depth),
children AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY k[1:depth - 1]),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
  CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.k[depth].text, '{WORDS}')) END AS saved
  FROM nodes n LEFT JOIN children c ON c.k = n.k),
totals AS (SELECT k[1:a] AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM valued) GROUP BY k[1:a])
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN totals t ON t.k = v.k LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.k = v.k[1:v.depth - 1]"""
