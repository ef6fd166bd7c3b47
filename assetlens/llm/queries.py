"""The registered queries of this package: opN_<name>(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm._shared import table


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.warc_index import capture_index

    out = capture_index(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from assetlens.llm.sp_agenda import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from assetlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.url_templates import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.cotrain import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.substring_dedup import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.decision_list import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.embedding_lsh import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.chat_windows import format_windows, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.spelling_variants import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.hard_negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assetlens.llm.class_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_packing": op5_packing,
    "op2_url_templates": op2_url_templates,
    "op6_cotraining": op6_cotraining,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_embedding_lsh": op9_embedding_lsh,
    "op10_chat_windows": op10_chat_windows,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_class_lm": op13_class_lm,
}
#: Words of a text in DuckDB, as they are or with A-Z lowered.
_WORD_LIST = "regexp_extract_all(coalesce({x},''),'[^\\x20\\x09-\\x0D]+')"
_LOWERED = "translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_REACHED = """reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b=l.a)"""
#: SQL where it can say what a query returns: op1, op3, op7, op9 and op12. The others learn, take checksums that DuckDB lacks, hash into windows or use a vocabulary.
ORACLES: dict[str, str] = {
    "op1_warc_index": """WITH p AS (SELECT page_id, url, encode(coalesce(html,'')) AS payload FROM pages), d AS (SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
 f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes>=100 GROUP BY 1), u AS (SELECT *, regexp_replace(coalesce(url,''),'^[^/?#]*://','') AS rest FROM d), h AS (SELECT *, regexp_extract(rest,'^[^/?#]*') AS host FROM u)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id<>page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id<>page_id THEN first_id END AS refers_to,
 translate(array_to_string(list_reverse(string_split(host,'.')),',')||')'||regexp_replace(substr(rest,length(host)+1),'#.*$',''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS url_key,
 strftime(make_timestamp((1704067200+page_id)*1000000),'%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM h LEFT JOIN f USING (payload_digest)""",
    "op3_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORD_LIST.format(x=_LOWERED)} AS w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)=0 THEN [] WHEN len(w)<3 THEN [array_to_string(w,' ')] ELSE list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s=y.s AND x.doc_id<>y.doc_id GROUP BY 1,2),
 link AS (SELECT a, b FROM c JOIN n na ON na.doc_id=a JOIN n nb ON nb.doc_id=b WHERE 100*c>=90*(na.n+nb.n-c)), {_REACHED}
 SELECT doc_id, coalesce(max(n),0)::BIGINT AS n_shingles, least(doc_id,coalesce(min(b),doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a=doc_id GROUP BY doc_id""",
    "op7_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORD_LIST.format(x="text")} AS w FROM documents), win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34],' ')) AS h FROM (SELECT doc_id, w, unnest(range(1,len(w)-33)) AS i FROM w WHERE len(w)>=35)),
 r AS (SELECT h FROM win GROUP BY 1 HAVING count(*)>1), hit AS (SELECT DISTINCT doc_id, i FROM win JOIN r USING (h)), gone AS (SELECT DISTINCT doc_id, i+k AS p FROM hit, range(0,35) t(k)), word AS (SELECT doc_id, unnest(w) AS v, unnest(range(1,len(w)+1)) AS p FROM w),
 kept AS (SELECT doc_id, count(*) AS n_words, count(gone.p) AS n_removed, sha256(coalesce(string_agg(v,' ' ORDER BY word.p) FILTER (gone.p IS NULL),'')) AS kept_sha256 FROM word LEFT JOIN gone USING (doc_id,p) GROUP BY 1)
 SELECT doc_id, coalesce(n_words,0)::BIGINT AS n_words, coalesce(n_removed,0)::BIGINT AS n_removed, coalesce(kept_sha256,sha256('')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op9_embedding_lsh": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0 AND list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[])>0),
 link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label=y.label AND len(x.e)=len(y.e) AND x.vec_id<>y.vec_id WHERE list_cosine_similarity(x.e,y.e)>=0.98), {_REACHED},
 n AS (SELECT a, count(*) AS n FROM link GROUP BY 1), c AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
 SELECT vec_id, coalesce(n,0)::BIGINT AS n_links, least(vec_id,coalesce(b,vec_id)) AS component_id, vec_id<=coalesce(b,vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a=vec_id LEFT JOIN c ON c.a=vec_id""",
    "op12_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256*x::DOUBLE)) AS z FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label=b.label AS alike, list_dot_product(a.z,b.z)::BIGINT AS score FROM r a JOIN r b ON a.vec_id<>b.vec_id WHERE a.vec_id%100=0), p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id)<=5)
 SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30*positive_score<=100*score AND 100*score<=90*positive_score QUALIFY rank<=10""",
}
