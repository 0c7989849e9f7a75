import collections
import random
import string

import corpus_pipeline
from gleaner.llm import language, mixing, near_dedup, packing, secrets
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10_001, "%%% ###", "en", "s", 7), (10_002, None, None, None, None), (10_003, 'the of and to in key token = "abcdefghijklmnop" the of', "en", "s", 50)], DOCS)
    docs = docs.unionByName(junk)
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        sizes.append(docs.count())
    assert docs.where("doc_id IN (10001, 10002)").count() == 0
    assert docs.where(F.col("text").contains("abcdefghijklmnop")).count() == 0
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1]


def test_run_equals_the_operators_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language.learn(docs)
    judge = language.Profiles(profiles).judge
    rows = [r for r in docs.collect() if judge(r.text)[0] != "und" and judge(r.text)[1] >= language.LEAST_SCORE]
    kept = {r.id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect() if r.kept}
    automata = secrets.learn(secrets.labelled_credentials())
    clean = {r.doc_id: secrets.redacted(r.text, secrets.spans(r.text, automata)) for r in rows if r.doc_id in kept}
    mixed = mixing.mix(spark.createDataFrame([r for r in rows if r.doc_id in kept], DOCS), copy_col=None)
    encode = packing.tokenizer()
    want = collections.Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(encode(clean[r.doc_id])) + 1
    got, sequences = collections.Counter(), collections.defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
        sequences[r.sequence_id, r.context_size] += r.length
    assert got == want
    assert all(n == size for (_, size), n in sequences.items())


def test_stages_with_clashing_names_and_repeated_rows(spark, sf_dir):
    names = ["lang_pred", "score", "uid", "_uid", "spans", "mix_key", "copy", "ids", "start", "length"]
    rows = [(i // 2, f"the and of to in that is for with key{i // 2} token = abcdefghijklmnop{i // 2} " * 3, "en", "ab"[i % 2], 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), *names] and all(r[n] == n for r in docs.collect() for n in names)
        sizes.append(docs.count())
    assert sizes[0] == 40 and sizes[1] <= 20 and docs.where(F.col("text").contains("abcdefghijklmnop")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_empty_tables_pass_through(spark, sf_dir, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 200")
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert kept.count() >= 0.98 * docs.count()


def test_texts_in_no_learned_language_go(spark, sf_dir):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits + "+/"
    foreign = [
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(300)),
        "".join(rng.choices(letters, k=3000)),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = ["the and of", "the of and to in key", "Le de la et les."]
    planted = [(20_000 + i, t, "en", "s", len(t)) for i, t in enumerate(foreign)] + [(30_000 + i, t, None, "s", len(t)) for i, t in enumerate(short)]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(planted, DOCS)), sf_dir).select("doc_id").collect()}
    assert not [i for i in range(len(foreign)) if 20_000 + i in kept]
    assert all(30_000 + i in kept for i in range(len(short)))
    assert {r.doc_id for r in docs.where(F.col("text").rlike("[a-z]")).select("doc_id").collect()} <= kept


def test_the_threshold_follows_the_labelled_scores(spark):
    texts = spark.createDataFrame([("en", "the and of to")] * 9 + [("en", "zq xj")], "lang string, text string")
    assert language.least_score(texts, language.profiles_of(texts)) == language.LEAST_SCORE
    assert language.least_score(texts, language.profiles_of(texts.where("text LIKE 'zq%'"))) < language.LEAST_SCORE
    assert language.least_score(texts.limit(0), {}) == language.LEAST_SCORE
