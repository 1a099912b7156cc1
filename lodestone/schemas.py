"""Record types, enumerations and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# They must be equal to those of the data that is exchanged.
CHUNK_TYPES = ["book", "secondary_book", "chapter_summary", "begriff", "talk", "talk_summary", "quote", "quote_explanation", "typology"]
WORLDVIEWS = [
    "Dynamismus", "Individualismus", "Mathematismus", "Materialismus", "Spiritualismus", "Idealismus", "Realismus",
    "Rationalismus", "Phänomenalismus", "Psychismus", "Sensualismus", "Pneumatismus",
]
SOURCE_TYPES = ["book", "article", "lecture", "manuscript", "transcript", "other"]
TALK_STATUSES = ["draft", "published", "personal", "bug"]
SHARED_PARTITION, SHARED_TYPES = "__shared__", ["book", "secondary_book"]
DEFAULT_SEARCH_TYPES = ["book", "secondary_book", "talk", "chapter_summary", "quote", "quote_explanation", "begriff", "typology"]
#: What a citation can be navigated to.
NAVIGATION_TYPES = ["book", "secondary_book", "talk", "quote", "quote_explanation"]
#: Intent -> chunk types that answer it (none: all types), and the intents that need no retrieval.
INTENT_TYPES = {"quelle_suchen": ["quote", "book", "talk"], "erklaerung": ["book", "talk", "chapter_summary", "secondary_book", "typology"], "sonstiges": []}
SKIP_INTENTS = ["skip"]
#: Payload fields that searches show: a change in one of them is written without a new vector.
SEARCH_KEYS = ["author", "book_title", "source_title", "segment_title", "source_type", "venue", "lecture_date", "vortragstitel", "parent_id", "lecture_id",
               "body_source_id", "paragraph_id", "paragraph"]
#: Names that are no author of a hit.
#: App type -> chunk types.
APP_TYPES = {"text": ["book", "secondary_book", "talk"], "concept": ["begriff", "typology"], "quote": ["quote", "quote_explanation"], "chapter_summary": ["chapter_summary"]}
INVITATIONS_PER_DAY, INVITATION_HOURS = 20, 48
NO_AUTHORS = ["philo-von-freisinn", "philo von freisinn"]
MIN_CHUNK_CHARS = 80
RRF_K, FUSED = 60, 30
CONTEXT_CHARS = 12_000
EMBED_CHARS = 1_550
SYSTEM_TOKENS = 800
SNIPPET_CHARS, REFERENCE_CHARS = 240, 500
TOKEN_LIMIT, TOKEN_WARN, TOKEN_SAFE = 512, 400, 450
#: model -> USD for a million prompt tokens and completion tokens; models without a price cost as much as DEFAULT_MODEL.
PRICES = {
    "deepseek-chat": (0.27, 1.10),
    "deepseek-reasoner": (0.55, 2.19),
    "deepseek-v4-flash": (0.14, 0.28),
    "deepseek-v4-pro": (0.435, 0.87),
}
DEFAULT_MODEL = "deepseek-v4-flash"
EUR_PER_USD = 0.92


def overfetch(k: int) -> int:
    """Candidates fetched for k hits, before the length filter."""
    return max(2 * k, k + 30)


CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("author", T.StringType()), T.StructField("source_id", T.StringType()),
        T.StructField("source_title", T.StringType()), T.StructField("source_index", T.IntegerType()),
        T.StructField("segment_id", T.StringType()), T.StructField("segment_title", T.StringType()),
        T.StructField("segment_index", T.IntegerType()), T.StructField("parent_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()), T.StructField("chunk_type", T.StringType()),
        T.StructField("worldviews", T.ArrayType(T.StringType())), T.StructField("worldview", T.StringType()),
        T.StructField("importance", T.IntegerType()), T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
        T.StructField("source_type", T.StringType()), T.StructField("book_title", T.StringType()),
        T.StructField("venue", T.StringType()), T.StructField("lecture_date", T.StringType()), T.StructField("vortragstitel", T.StringType()),
        T.StructField("lecture_id", T.StringType()), T.StructField("paragraph", T.IntegerType()), T.StructField("body_source_id", T.StringType()),
        T.StructField("paragraph_id", T.StringType()), T.StructField("language", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("quote_span", T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
        T.StructField("quote_verified", T.BooleanType()),
        T.StructField("references", T.ArrayType(T.StructType([
            T.StructField("chunk_id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("relevance", T.DoubleType())]))),
    ])),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
