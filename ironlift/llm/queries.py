"""The registered queries: each applies its operator to a whole table and derives the digests that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


#: The vocabulary file of op1 and op2; a parameter of their operators.
TOKENIZER = "byte_bpe_50k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import read_tokens, write_tokens

    index = write_tokens(read_table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)
    return read_tokens(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import cut_documents, pack

    pieces = cut_documents(read_table(spark, sf_dir, "documents"), TOKENIZER, end_id=0)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import arc_blocks, convert, read_warc, write_warc

    files = write_warc(convert(arc_blocks(read_table(spark, sf_dir, "pages"))))
    return read_warc(files, with_payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    m = F.col("match")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ",").cast("binary"), 256).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii

    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op6_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shuffle_shards, size_of

    out = shuffle_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return out.select(
        "doc_id", size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "stats.*", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import fit, held_out

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants, spoiled_counts

    return group_variants(spoiled_counts(read_table(spark, sf_dir, "documents")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fit(docs, read_table(spark, sf_dir, "labels")).score(docs)
    t = F.col("toxicity")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), t["score"].alias("score"), (t["score"] >= 0.5).cast("int").alias("predicted"), F.size(t["passages"]).cast("long").alias("n_passages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_pack": op2_pack,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_shuffle_shards": op6_shuffle_shards,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_remove_repeats": op8_remove_repeats,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}
#: The terms of op11 and the letter runs of op12, lower-cased from A to Z only.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: crc32 of the UTF-8 bytes of s, bit by bit, for code points up to U+00FF.
_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
_BITS = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_BYTES}, lambda b: b::BIGINT)), lambda crc, byte: {_BITS}), 4294967295)"
#: The words of op4 and op7.
_WORDS = _TERMS
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
        b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
        wanted AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
            FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
        windows AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
            FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM wanted) WHERE len(words) >= size)),
        found AS (SELECT doc_id, item_id, i, size FROM windows JOIN wanted USING (size, win)),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_near_duplicates": f"""
        WITH RECURSIVE node AS (SELECT text, min(doc_id) AS node, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
        worded AS (SELECT node, {_WORDS} AS words FROM node),
        shingle AS (SELECT DISTINCT node, array_to_string(words[i:i + least(len(words), 5) - 1], ' ') AS s
            FROM (SELECT node, words, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS i FROM worded WHERE len(words) > 0)),
        sized AS (SELECT node, count(*) AS n FROM shingle GROUP BY node),
        shared AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN sized x ON a = x.node JOIN sized y ON b = y.node WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-9),
        reach AS (SELECT node AS a, node AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        class AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a),
        counted AS (SELECT class_id, CAST(sum(copies) AS BIGINT) AS n_class FROM class JOIN node USING (node) GROUP BY class_id)
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_class, 1) AS n_class
        FROM documents d LEFT JOIN node ON d.text = node.text LEFT JOIN class USING (node) LEFT JOIN counted USING (class_id)""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE held AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        counted AS (SELECT run, concat(doc_id, ':', run) AS s, count(*) AS n FROM held GROUP BY doc_id, run),
        hashed AS (SELECT run, n, {_CRC32} AS h FROM counted),
        spoiled AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2, length(run))) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS (SELECT word, i, concat(substring(word, 1, i - 1), '\n', substring(word, i + 1, length(word))) AS hole, concat(substring(word, 1, i - 1), substring(word, i + 1, length(word))) AS less
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b USING (hole) WHERE a.word <> b.word
            UNION SELECT w.word, c.word FROM words w JOIN cut c ON w.word = c.less UNION SELECT c.word, w.word FROM words w JOIN cut c ON w.word = c.less),
        best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS near, max(w.n) AS m FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
        formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
        way AS (SELECT word, word AS at FROM formed UNION ALL SELECT way.word, formed.form FROM way JOIN formed ON way.at = formed.word WHERE formed.form IS NOT NULL)
        SELECT f.word, f.n, f.form, w.at AS root, f.n_near, f.form_n FROM formed f JOIN way w ON f.word = w.word JOIN formed e ON w.at = e.word AND e.form IS NULL""",
    "op11_ranked_search": f"""
        WITH held AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
        sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
        totals AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l FROM sizes),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
        wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l)))) AS BIGINT) AS score
            FROM wanted JOIN tfs USING (term) JOIN w USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op3_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
}
