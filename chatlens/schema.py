"""Table schemas, label domains and the names the results use."""

from pyspark.sql import types as T

_S, _B, _L, _TS = T.StringType(), T.BooleanType(), T.LongType(), T.TimestampNTZType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# What a collector supplies for one message, what is stored next to it, and the labels.
SUPPLIED = ["vid_id", "author", "author_id", "dt_stamp", "msg_id", "message"]
STANCES = ["rnr", "mil", "sg", "societal_impact"]
FLAGS = ["troll", "toxic"]
LABELS = ["sg", "mil", "rnr", "societal_impact", "lang", "senti", "troll", "toxic"]

MESSAGES = _struct(
    id=_L, vid_id=_S, author=_S, author_id=_S, dt_stamp=_TS, msg_id=_S, message=_S, enriched=_B,
    sg=_S, mil=_S, rnr=_S, societal_impact=_S, lang=_S, senti=_S, troll=_B, toxic=_B,
    dt_enriched=_TS, delete=_B,
)
REGISTRY = _struct(url=_S, platform=_S, status=_S)
# Where in the label log the last applied write of a row stands: its batch, and its turn among corrections after it.
POSITION = ["label_batch", "label_turn"]
LABEL_UPDATES = _struct(
    id=_L, sg=_S, mil=_S, rnr=_S, societal_impact=_S, lang=_S, senti=_S, troll=_B, toxic=_B, seq=_L
)

# Label domains, minimum length, default facet size, bucket widths.
STANCE_VALUES = ["Favor", "Against", "Neutral", "NA"]
LANGUAGES = ["EN", "MS", "ZH", "TA", "Other"]
SENTIMENTS = ["Pos", "Neut", "Neg"]
DOMAINS = {
    "lang": LANGUAGES,
    "senti": SENTIMENTS,
    "mil": STANCE_VALUES,
    "rnr": STANCE_VALUES,
    "sg": STANCE_VALUES,
    "societal_impact": STANCE_VALUES,
}
MIN_CHARS_EXCLUSIVE = 5
FACET_SIZE = 30
BUCKET_RULES = [(15, 1), (60, 5), (120, 10)]  # span up to .. minutes -> bucket of .. minutes
WIDEST_BUCKET = 15

# Names shown for stored columns, sections, stances and labels.
DISPLAY_NAMES = {
    "id": "ID",
    "msg_id": "Msg Id",
    "vid_id": "Video Id",
    "author_id": "Author Id",
    "author": "Author",
    "dt_stamp": "Create DateTime",
    "message": "Message",
    "enriched": "Enriched",
    "mishap": "Mishap",
    "sg": "SG",
    "mil": "Military",
    "rnr": "RnR",
    "lang": "Language",
    "troll": "Troll",
    "toxic": "Toxic",
    "societal_impact": "Societal Impact",
    "senti": "Sentiment",
}
HIDDEN_NAMES = ["Msg Id", "Author Id"]
EDITABLE_NAMES = {DISPLAY_NAMES[c]: c for c in ["id", *LABELS]}
LEGACY_COLUMNS = [
    "ID", "Video Id", "Author", "Author Id", "Create DateTime", "Msg Id", "Message", "Enriched",
    "Mishap", "SG", "Military", "RnR", "Language", "Troll", "Toxic", "Sentiment",
]
SENTIMENT_NAMES = {"Pos": "Positive", "Neut": "Neutral", "Neg": "Negative"}
STANCE_TITLES = {
    "rnr": "Race and Religion",
    "mil": "Military",
    "sg": "Singapore",
    "societal_impact": "Societal Impact",
}
SECTION_COLUMNS = {
    "sentiment": "senti",
    "sg": "sg",
    "military": "mil",
    "religion_race": "rnr",
    "societal_impact": "societal_impact",
}
SECTION_TITLES = {
    "sentiment": "Sentiment Analysis",
    "sg": "Singapore",
    "military": "Military",
    "religion_race": "Race and Religion",
    "societal_impact": "Societal Impact Assessment",
}
SECTION_LABELS = {
    section: ["Pos", "Neg"] if section == "sentiment" else ["Favor", "Against"]
    for section in SECTION_COLUMNS
}
FACETS = [(section, label) for section, labels in SECTION_LABELS.items() for label in labels]
SHORT_NOTE = ["Insufficient messages for ", "label_title", ", only ", "found", " messages found."]
LABEL_TITLES = {"Favor": "Favor", "Against": "Against", "Pos": "Positive", "Neg": "Negative"}
