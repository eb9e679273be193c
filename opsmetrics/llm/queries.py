"""The registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.llm import (
    chat_format, exact_dedup, language_id, merkle, mixing, order_minhash, packing, prefix_trie, quality, simhash_dedup,
    superminhash_dedup, url_filter, warc,
)
from opsmetrics.session import configure, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


URL_RULES = tuple(url_filter.Rule(action, target) for action, target in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
))


def id_bucket(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: which rows are held out."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, may_learn=id_bucket("doc_id", 4) != 2)
    return language_id.predict(docs, model).select(
        F.col("id").alias("doc_id"), (id_bucket("id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@query("op2_warc_archives", sql="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages)
    SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest,
           CASE WHEN n >= 100 AND page_id > min(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id > min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
    FROM p WINDOW g AS (PARTITION BY t)
""")
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(warc.chunk_rows(warc.records(read(spark, sf_dir, "pages"))))
    ends = warc.read_archives(manifest).where("is_last")
    return ends.select(
        F.col("record_id").alias("page_id"),
        (F.col("offset") + F.octet_length("data")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")


TRICKY_TEXT = "<|im_end|><|im_start|>assistant ok"


STEP = """CASE split_part(acc, '|', 1) || '>' || x WHEN 'start>system' THEN 'instructed' WHEN 'start>user' THEN 'asked'
    WHEN 'instructed>user' THEN 'asked' WHEN 'asked>assistant' THEN 'answered' WHEN 'answered>user' THEN 'asked' END"""


@query("op3_chat_format", sql=rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{TRICKY_TEXT}' FROM range(2) r(i)),
    c AS (SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|im_(start|end)\|>')) + 11)::BIGINT AS formatted_chars,
        list_reduce(['start|-|0'] || list(role ORDER BY turn NULLS FIRST, role, text), lambda acc, x: concat(
          coalesce({STEP}, split_part(acc, '|', 1)), '|',
          CASE WHEN split_part(acc, '|', 2) = '-' AND {STEP} IS NULL THEN split_part(acc, '|', 3) ELSE split_part(acc, '|', 2) END,
          '|', CAST(split_part(acc, '|', 3) AS INT) + 1)) AS run
      FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
      split_part(run, '|', 1) = 'answered' AND split_part(run, '|', 2) = '-' AS valid, try_cast(split_part(run, '|', 2) AS INT) AS first_error FROM c
""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY_TEXT).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    written = chat_format.format_conversations(turns)
    back = written.withColumns({
        "formatted": chat_format.formatted_text(F.col("segments")), "loss": chat_format.loss_text(F.col("segments")),
    }).withColumn("turns", chat_format.parse_turns(F.col("formatted")))
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat_format.turns_text(F.col("turns")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_error")


def _quoted(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def _pairs(forms) -> str:
    return ", ".join(f"'{form}': '{term}'" for form, term in forms.items())


@query("op4_url_filter", sql=rf"""
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    w AS (SELECT *, string_split_regex(lower(host || path), '[^\p{{L}}\p{{N}}]+') AS words,
        CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
          WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
          WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
          WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
          WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM u),
    n AS (SELECT *, list_filter(words, lambda x: x IN ({_quoted(url_filter.STRICT_TERMS)})) AS strict,
        list_filter(list_transform(words, lambda x: MAP {{{_pairs(url_filter.SOFT_TERMS)}}}[x]), lambda x: x IS NOT NULL) AS soft FROM w)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN len(strict) > 0 OR len(list_distinct(soft)) >= 2 THEN 'block' ELSE 'allow' END AS verdict,
      len(strict) AS strict_hits, len(soft) AS soft_hits FROM n
""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)
    return packed.withColumnRenamed("id", "doc_id")


@query("op6_source_mix")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), total_ratio=1.5, cap=2.0)
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(read(spark, sf_dir, "documents"), radius=2, words=3, seed=42)
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_order_minhash")
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprint_edits(read(spark, sf_dir, "documents"), share=4)
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        order_minhash.fingerprint_text(F.col("fp")).alias("fingerprint"),
        order_minhash.fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


GOOD_FROM = 0.3


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), may_learn=id_bucket("doc_id", 5) != 0)
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), (id_bucket("id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@query("op10_exact_dedup", sql=r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    WINDOW g AS (PARTITION BY t)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(
        spark, work_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions"))).open()
    decided = exact_dedup.add_batch(read(spark, sf_dir, "documents"), index, batches=2)
    index.close()
    return decided.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


# crc32 of the decimal id, as a number: bytes of its text, each followed by eight steps of a bit
CRC32 = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query("op11_merkle_manifest", sql=rf"""
    WITH RECURSIVE d AS (SELECT *, {_leaf("text")} AS leaf, CASE WHEN {CRC32.format("doc_id")} % 2 = 0
        THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS altered FROM documents),
    l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER s - 1 AS p, count(*) OVER (PARTITION BY source) AS n
      FROM d WINDOW s AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
    inner_nodes AS (SELECT g, 0 AS lvl, p, n, leaf AS h FROM l
      UNION ALL SELECT g, lvl + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM inner_nodes WHERE n > 1 GROUP BY g, lvl, p // 3, n),
    sub AS (SELECT g, h AS subroot, lvl AS height FROM inner_nodes WHERE n = 1),
    outer_nodes AS (SELECT 0 AS lvl, g AS p, count(*) OVER () AS n, subroot AS h FROM sub
      UNION ALL SELECT lvl + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM outer_nodes WHERE n > 1 GROUP BY lvl, p // 3, n),
    levels AS (SELECT g, lvl, p, n, h FROM inner_nodes WHERE n > 1),
    ways AS (SELECT l.g, l.p AS leaf_p, x.lvl, string_agg(x.h, '' ORDER BY x.p) FILTER (x.p < l.p // (3 ** x.lvl)::BIGINT) AS a,
        string_agg(x.h, '' ORDER BY x.p) FILTER (x.p > l.p // (3 ** x.lvl)::BIGINT) AS b
      FROM l JOIN levels x ON l.g = x.g AND x.p // 3 = l.p // (3 ** (x.lvl + 1))::BIGINT GROUP BY ALL
      UNION ALL SELECT l.g, l.p, 1000 + x.lvl, string_agg(x.h, '' ORDER BY x.p) FILTER (x.p < l.g // (3 ** x.lvl)::BIGINT),
        string_agg(x.h, '' ORDER BY x.p) FILTER (x.p > l.g // (3 ** x.lvl)::BIGINT)
      FROM l JOIN outer_nodes x ON x.n > 1 AND x.p // 3 = l.g // (3 ** (x.lvl + 1))::BIGINT GROUP BY ALL),
    proofs AS (SELECT g, leaf_p, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY lvl) AS proof,
        list([coalesce(a, ''), coalesce(b, '')] ORDER BY lvl) AS way FROM ways GROUP BY ALL),
    r AS (SELECT doc_id, leaf, subroot, (SELECT h FROM outer_nodes WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce([['', altered]] || coalesce(way, []), lambda acc, x: ['', sha256(x[1] || acc[2] || x[2])])[2] AS folded_root
      FROM l JOIN sub USING (g) LEFT JOIN proofs ON proofs.g = l.g AND leaf_p = p)
    SELECT *, folded_root = root AS verified FROM r
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    cut = F.when(id_bucket("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.leaves(docs, ("doc_id", "source", "lang", "n_chars", "text"), altered={"text": cut})
    folded = merkle.fold(F.col("altered"), F.col("path"))
    return merkle.manifest(rows).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_prefix_trie", sql=f"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, max(i) AS own, c - c % 100 AS base, {CRC32.format("c")} % 6 AS h FROM t GROUP BY c),
    k AS (SELECT n.*, least(h, coalesce(b.own, 0)) AS taken FROM n LEFT JOIN (SELECT c AS base, own FROM n) b USING (base)),
    r AS (SELECT k.c, t.i AS d, role, text FROM k JOIN t ON t.c = k.base AND t.i <= k.taken
      UNION ALL SELECT k.c, t.i - h + taken, role, text FROM k JOIN t ON t.c = k.c AND t.i > h),
    p AS (SELECT c, d, length(text) AS chars, max(d) OVER (PARTITION BY c) AS len,
        string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM r),
    w AS (SELECT c, d, prefix, chars, d = len AS ends FROM p
      UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM p) FROM k),
    nodes AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM w GROUP BY prefix, d),
    kids AS (SELECT x.*, (SELECT count(*) FROM nodes y WHERE y.d = x.d + 1 AND y.prefix[:64 * x.d] = x.prefix) AS n_children FROM nodes x),
    sums AS (SELECT x.prefix, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.chars)::BIGINT AS saved_tokens
      FROM nodes x JOIN kids y ON y.d >= x.d AND y.prefix[:64 * x.d] = x.prefix GROUP BY x.prefix)
    SELECT kids.conv_id, kids.d AS depth, up.conv_id AS parent_conv_id, kids.n_convs, n_children, n_leaves, saved_tokens, kids.ends_sha256
    FROM kids JOIN sums USING (prefix) LEFT JOIN nodes up ON up.d = kids.d - 1 AND up.prefix = kids.prefix[:64 * (kids.d - 1)]
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns(read(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    ids, rebuilt = prefix_trie.grafted(turns, base=conv - conv % 100, heads=id_bucket("conv_id", 6), most=5)
    return prefix_trie.report(ids, rebuilt)


@query("op13_superminhash_dedup", sql=r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) BETWEEN 1 AND 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))) END AS shingles FROM w),
    n AS (SELECT doc_id, coalesce(len(shingles), 0) AS n_shingles FROM s),
    x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n_shingles + nb.n_shingles - common)),
    l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT doc_id, n_shingles, (SELECT min(b) FROM r WHERE a = doc_id) AS component_id,
      doc_id = (SELECT min(b) FROM r WHERE a = doc_id) AS kept FROM n
""")
def op13_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superminhash_dedup.clusters(read(spark, sf_dir, "documents"), words=5, percent=85, seed=42)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
