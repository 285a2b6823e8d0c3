import argparse

from textscore.plans import report, stages
from textscore.session import session
from textscore.sources import readers
from textscore.sources.work import SETTING, working


def main():
    parser = argparse.ArgumentParser(prog="textscore", description=stages.__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("stage", choices=["clean", "tokenise", "search", "predict", "embed"])
    parser.add_argument("--out", required=True, help="folder of the tables handed on")
    for name in ("scores", "speaker-map", "speeches", "ad-texts", "airings"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--single-line", action="store_true",
                        help="no quoted field spans lines: files are read once instead of three times")
    parser.add_argument("--holdout", action="store_true", help="search without the test share")
    parser.add_argument("--stopwords", help="text file, one word per line")
    parser.add_argument("--embeddings", help="Parquet table (unique_id, embedding, dime)")
    parser.add_argument("--lemmas", help="Parquet table (form, lemma)")
    parser.add_argument("--table", help="predict: another tokenised table than the training speeches")
    parser.add_argument("--work", help="folder all executors share, for working tables")
    args = parser.parse_args()
    spark = session(**({SETTING: args.work} if args.work else {}))
    with working(spark):
        run(spark, args)


def run(spark, args):
    if args.stage == "clean":
        done = stages.clean_stage(spark, args.out, args.scores, args.speaker_map, args.speeches,
                                  args.ad_texts, args.airings, not args.single_line)
        for name, summary in done.items():
            print(name)
            summary.show()
    elif args.stage == "tokenise":
        words = readers.read_words(spark, args.stopwords) if args.stopwords else None
        lemmas = readers.read_table(spark, args.lemmas) if args.lemmas else None
        for name, stats in stages.tokenise_stage(spark, args.out, words, lemmas).items():
            print(name)
            stats.show()
        stages.speaker_stage(spark, args.out)
    elif args.stage == "search":
        for part in report.report(stages.search_stage(spark, args.out, args.holdout).results).values():
            part.show(truncate=False)
    elif args.stage == "embed":
        print(stages.embedding_stage(spark, args.out, args.embeddings))
    else:
        stages.predict_stage(spark, args.out, args.table)


if __name__ == "__main__":
    main()
