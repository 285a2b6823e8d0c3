"""The stages from raw files to a fitted model, handing on Parquet tables.

    python -m textscore clean    --out OUT --scores S.csv --speaker-map M.txt --speeches T.txt
                                 [--ad-texts FOLDER] [--airings TABLE] [--single-line]
    python -m textscore tokenise --out OUT [--stopwords FILE] [--lemmas TABLE]
    python -m textscore search   --out OUT [--holdout]
    python -m textscore predict  --out OUT
    python -m textscore embed    --out OUT --embeddings TABLE
"""

from pyspark.sql import functions as F

from textscore import settings
from textscore.operators import ridge
from textscore.plans import airings, clean, embed, report, search, speakers, tokens
from textscore.sources import readers, writers
from textscore.sources.work import materialise

ORDER = ["speech_id", "cycle"]


def clean_stage(spark, out, scores, speaker_map, speeches, ad_texts=None, airings_table=None,
                multi_line=True):
    """Cleaned speeches, all scored airings, one row per ad with a transcript.

    Airings need no transcripts; without them only the table of unique ads is left out.
    """
    # The score table is read by three joins; its filtered rows are written once.
    writers.write_table(clean.clean_scores(readers.read_scores(spark, scores, multi_line)), f"{out}/scores")
    known = readers.read_table(spark, f"{out}/scores")
    keyed = clean.keyed_speeches(readers.read_speaker_map(spark, speaker_map, multi_line=multi_line),
                                 readers.read_speeches(spark, speeches, multi_line=multi_line))
    writers.write_table(clean.join_scores(keyed, known, keep_cycle=True), f"{out}/cleaned_speeches")
    if airings_table:
        writers.write_table(airings.scored_airings(readers.read_table(spark, airings_table), known),
                            f"{out}/scored_airings")
        scored = readers.read_table(spark, f"{out}/scored_airings")
        writers.write_if_rows(airings.clean_airings(scored), f"{out}/cleaned_ads_airings")
        if ad_texts:
            texts = readers.read_texts(spark, ad_texts)
            writers.write_if_rows(airings.unique_ads(texts, scored), f"{out}/cleaned_ads_unique")
    return {name: report.summary(table, entity) for name, entity in (
        ("cleaned_speeches", "speakerid"), ("cleaned_ads_airings", "vidfile"),
        ("cleaned_ads_unique", "unique_id"))
        if (table := readers.read_optional(spark, f"{out}/{name}")) is not None}


def _tokens(df, column, out, stopwords, lemmas):
    cut = tokens.tokenise(df, column, out, stopwords)
    if lemmas is None:
        return cut
    return tokens.lemmatise_arrays(cut, lemmas, out)


def tokenise_stage(spark, out, stopwords=None, lemmas=None):
    """Token arrays of speeches, which must exist, and of ads, which may be missing."""
    done = {}
    jobs = [("cleaned_speeches", "speech", "tokenized_speech", "tokenized_speeches", True),
            ("cleaned_ads_unique", "ad_text", "tokenized_ad", "tokenized_ads_unique", False)]
    for source, column, array, target, required in jobs:
        read = readers.read_table if required else readers.read_optional
        df = read(spark, f"{out}/{source}")
        if df is not None:
            writers.write_table(_tokens(df, column, array, stopwords, lemmas), f"{out}/{target}")
            done[target] = report.token_stats(readers.read_table(spark, f"{out}/{target}"))
    return done


def speaker_stage(spark, out):
    """One row per speaker, and the speakers' concatenated tokens in bounded arrays."""
    speeches = readers.read_table(spark, f"{out}/tokenized_speeches").withColumnRenamed(
        "tokenized_speech", "tokens")
    writers.write_table(speakers.speaker_scores(speeches, ["cycle", "speech_id"]), f"{out}/speakers")
    writers.write_table(speakers.speaker_chunks(speeches, ORDER),
                        f"{out}/agg_tokenized_speeches")


def search_stage(spark, out, holdout=False, **grid):
    """Grid search over the tokenised tables; results and model are written.

    With `holdout` the speakers of the fixed test share take no part in it.
    """
    ads = readers.read_table(spark, f"{out}/tokenized_ads_unique").withColumnRenamed("tokenized_ad", "tokens")
    speeches = readers.read_table(spark, f"{out}/tokenized_speeches").withColumnRenamed(
        "tokenized_speech", "tokens")
    if holdout:
        speeches = embed.holdout(speeches, "unique_id").where(~F.col("test")).drop("test")
    found = search.grid_search(ads, speeches, ORDER, score_order=["cycle", "speech_id"], **grid)
    writers.write_table(found.results, f"{out}/tfidf_cv_results")
    writers.save_model(found.model, f"{out}/tfidf_model")
    return found


def embedding_stage(spark, out, table, key="unique_id", target="dime", column="embedding",
                    alphas=settings.EMBEDDING_ALPHAS, folds=settings.FOLDS):
    """Ridge on given embeddings: results by alpha, the best model, its predictions."""
    df = readers.read_table(spark, table)
    fits = materialise(embed.embedding_search(df, key, target, column, alphas, folds), "fits")
    writers.write_table(embed.embedding_scores(fits), f"{out}/embeddings_cv_results")
    results = readers.read_table(spark, f"{out}/embeddings_cv_results")
    best = results.orderBy(F.desc("cv_r2_mean"), "alpha").first()
    model = fits.where((F.col("fit") == ridge.FULL) & (F.col("alpha") == best["alpha"])).select(
        "alpha", "intercept", "weights")
    writers.write_table(model, f"{out}/embeddings_model")
    scored = embed.score_embeddings(df.where(F.col(column).isNotNull()), model.first(), column)
    writers.write_table(scored.select(key, "prediction"), f"{out}/embeddings_predictions")
    return best


def predict_stage(spark, out, table=None, order=ORDER):
    """Predictions for all speakers of the tokenised speeches, marked if of the test share.

    `table` names another tokenised table (unique_id, tokenized_speech or tokens, order columns).
    """
    speeches = readers.read_table(spark, table or f"{out}/tokenized_speeches").withColumnRenamed(
        "tokenized_speech", "tokens")
    model = writers.load_model(spark, f"{out}/tfidf_model")
    predictions = embed.holdout(model.predict(speeches, "unique_id", order), "unique_id")
    writers.write_table(predictions, f"{out}/tfidf_predictions")
