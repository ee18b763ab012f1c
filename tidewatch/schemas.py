"""Fixed schemas of events, hits and flagged rows."""

from pyspark.sql import types as T

# The four event kinds.
POST = "app.bsky.feed.post"
REPOST = "app.bsky.feed.repost"
FOLLOW = "app.bsky.graph.follow"
PROFILE = "app.bsky.actor.profile"

# Rule identifiers and the constant reasons.
SPAM_RULE = "spam.keyword"
LINK_RULE = "link.blocklist"
RATE_RULE = "rate.spike"
SPAM_REASON = "matched spam keyword(s)"
LINK_REASON = "link host on blocklist"

STRINGS = T.ArrayType(T.StringType())
EVIDENCE = T.MapType(T.StringType(), T.StringType())

EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("did", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("langs", STRINGS),
    T.StructField("links", STRINGS),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("received_at", T.TimestampType()),
])

HIT = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("evidence", EVIDENCE),
])

FLAGGED = T.StructType([
    T.StructField("bucket_hour", T.TimestampType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("did", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("evidence", EVIDENCE),
])

BY_DID = ["did", "received_at", "id", "kind", "text", "langs", "links", "created_at"]
BY_MINUTE = ["kind", "bucket_minute", "received_at", "id", "did", "text", "langs", "links",
             "created_at"]

# Primary keys: a write with an equal key replaces the earlier row.
BY_DID_KEY = ["did", "received_at", "id"]
BY_MINUTE_KEY = ["kind", "bucket_minute", "received_at", "id"]
FLAGGED_KEY = ["bucket_hour", "received_at", "id", "rule_id"]
