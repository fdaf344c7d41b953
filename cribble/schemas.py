"""Table schemas shared by sources, operators and tests."""

from pyspark.sql import types as T

LEXICON_DETAILS = T.StructType([
    T.StructField("lb", T.IntegerType()),
    T.StructField("msa", T.IntegerType()),
    T.StructField("egy", T.IntegerType()),
    T.StructField("gulf", T.IntegerType()),
    T.StructField("sy", T.IntegerType()),
    T.StructField("strong_lb_hits", T.IntegerType()),
    T.StructField("msa_ratio_core", T.DoubleType()),
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("lexicon_score", T.DoubleType()),
])

DIAGNOSTICS = T.StructType([
    T.StructField("final_score", T.DoubleType()),
    T.StructField("lex_score", T.DoubleType()),
    T.StructField("lexicon_details", LEXICON_DETAILS),
    T.StructField("adi", T.StringType()),
])

REJECTION = T.StructType([
    T.StructField("model_probability", T.DoubleType()),
    T.StructField("diagnostics", DIAGNOSTICS),
])

METADATA = T.MapType(T.StringType(), T.StringType())

QUEUE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("discovered_at", T.TimestampType()),
    T.StructField("last_update_at", T.TimestampType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("audio_path", T.StringType()),
    T.StructField("duration_seconds", T.IntegerType()),
    T.StructField("rejection_reason", REJECTION),
    T.StructField("source_metadata", METADATA),
])

SAMPLE = T.StructType([
    T.StructField("chunk_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("language_probability", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]))),
])

TRANSCRIPT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("screening_samples", T.ArrayType(SAMPLE)),
])

ENCLOSURE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("type", T.StringType()),
])

LINK = T.StructType([T.StructField("href", T.StringType())])

FEED_ITEM = T.StructType([
    T.StructField("feed_url", T.StringType()),
    T.StructField("source_pos", T.LongType()),
    T.StructField("item_pos", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("guid", T.StringType()),
    T.StructField("enclosures", T.ArrayType(ENCLOSURE)),
    T.StructField("links", T.ArrayType(LINK)),
])

TRUSTED_SOURCE = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("polarity", T.StringType(), False),
])

LEXICON = T.StructType([
    T.StructField("lexicon", T.StringType(), False),
    T.StructField("term", T.StringType(), False),
])

CONTRASTIVE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("dialect", T.StringType()),
    T.StructField("audio", T.StructType([T.StructField("bytes", T.BinaryType())])),
])

ANNOTATION = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("source_status", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("audio_path", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])
