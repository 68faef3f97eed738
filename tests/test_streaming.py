from pyspark.sql import functions as F

from postlab.functions import text as T
from postlab.functions.matching import count_lexicon_terms
from postlab.functions.tokens import tokenize
from postlab.operators.models import fit_text_model, predict
from postlab.plans import views
from postlab.session import workspace
from postlab.sources.posts import POSTS, write_delimited
from postlab.streaming.posts import stream_posts, write_available


def test_row_local_work_gives_the_same_on_a_stream(spark, sf):
    batch = views.posts(spark, sf).select(*POSTS.names)
    folder = write_delimited(batch, workspace(spark), "\t")

    def prepared(df):
        cleaned = df.withColumn("text", T.clean_text(F.col("text"), T.TRAIN))
        return cleaned.withColumns({
            "tokens": tokenize(F.col("text")),
            "hits": count_lexicon_terms(F.col("text"), ["the", "de la"])})

    model = fit_text_model(prepared(batch), "language", "logistic_regression", maxIter=5)

    def work(df):
        return predict(model, prepared(df), ("id", "text", "hits"))

    target = workspace(spark)
    write_available(
        work(stream_posts(spark, folder)), target, workspace(spark)).awaitTermination(120)
    streamed = spark.read.parquet(target)
    expected = work(batch)
    assert streamed.count() == expected.count() == 200
    assert streamed.exceptAll(expected).count() == 0
