"""Documents for the small tests of the training-data operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def documents(spark, texts, partitions=2):
    """texts: texts, or pairs of an id and a text."""
    rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(partitions)


#: Nulls, empty and very long texts, ties, repeated rows, odd characters.
ODD = [None, "", " \n\t ", "one", "one two three", "one two three", "a b c d e", "A B C D E", "été l'été ça n'a rien 🙂", "x" * 5000, "word " * 3000, "I'll  don't<|endoftext|> we've\r\n\r\n", "'", "  lead", "trail  ", "1234 56-78 1e9", "\x00nul\x00"]
