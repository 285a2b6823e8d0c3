"""Input contracts. Column names are fixed values: they are the file formats read."""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCORES = T.StructType([
    T.StructField("cycle", T.IntegerType()),
    T.StructField("seat", T.StringType()),
    T.StructField("lname", T.StringType()),
    T.StructField("distcyc", T.StringType()),
    T.StructField("dwdime", T.DoubleType()),
    T.StructField("gen.vote.pct", T.DoubleType()),
    T.StructField("gwinner", T.StringType()),
])

SPEAKER_MAP = _schema(
    speakerid=T.LongType(), speech_id=T.LongType(), lastname=T.StringType(),
    firstname=T.StringType(), state=T.StringType(), district=T.DoubleType(),
)

SPEECHES = _schema(speech_id=T.LongType(), speech=T.StringType())

AD_TEXT = _schema(vidfile=T.StringType(), ad_text=T.StringType())

# Issue columns (`issue10`, `issue11`, ...) come on top and are found by name.
CV_RESULTS = _schema(
    min_df=T.IntegerType(), max_df=T.DoubleType(), ridge_alpha=T.DoubleType(),
    max_ngram=T.IntegerType(), vocab_size=T.LongType(), cv_r2_mean=T.DoubleType(),
    cv_r2_std=T.DoubleType(), cv_mse_mean=T.DoubleType(), cv_mse_std=T.DoubleType(),
    train_r2=T.DoubleType(), evaluation_time=T.DoubleType(), success=T.BooleanType(),
    error=T.StringType(),
)
