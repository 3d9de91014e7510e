"""Fixed values of the graph's vocabulary and thresholds."""

ENTITY_TYPES = (
    "Character", "Faction", "Location", "Artifact", "Event", "Component", "Material",
    "Concept", "Creature", "Title", "Document", "Date", "Condition", "Measurement",
)
UNKNOWN = "unknown"
RELATION_TYPES = (
    "member_of", "leads", "led_by", "allied_with", "enemy_of", "reports_to", "created_by",
    "located_in", "contains", "adjacent_to", "originates_from",
    "caused_by", "causes", "succeeded_by", "preceded_by", "occurred_during", "participates_in",
    "depends_on", "required_by", "composed_of", "part_of", "powers", "powered_by", "controls", "controlled_by",
    "possesses", "possessed_by", "has_property", "refers_to", "related_to", "contradicts",
)
PROPERTY = "has_property"
CONTRADICTORY = (("allied_with", "enemy_of"), ("leads", "reports_to"), ("enemy_of", "member_of"))
INVERSE_PAIRS = (
    ("leads", "led_by"), ("located_in", "contains"), ("causes", "caused_by"), ("succeeded_by", "preceded_by"),
    ("depends_on", "required_by"), ("composed_of", "part_of"), ("powers", "powered_by"), ("controls", "controlled_by"), ("possesses", "possessed_by"),
)
INVERSES = {a: b for p in INVERSE_PAIRS for a, b in (p, p[::-1])}
LEAK_PATTERNS = (
    "any faction", "any entity", "any character", "any location", "any named", "any other",
    "named power", "named entity", "one of the", "matching one of", "14 entity types",
)
CLAUSE_MARKERS = (" to ", " of the ", " that ", " which ", " or other ", " is ", " are ")
CLAUSE_WORDS = 3
MOST_WORDS = 8
MERGE_AT, REVIEW_AT = 92, 85
LOW_CONFIDENCE, DEFAULT_CONFIDENCE = 0.4, 0.5
RELIABILITY = ("high", "medium", "low")
DOC_TYPES = (("codex", "high"), ("wiki", "medium"), ("novel", "medium"), ("ephemera", "low"))
EXTENSIONS = ("pdf", "docx", "md", "txt", "jpg", "jpeg", "png")
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 150
SEPARATORS = ("\n\n", "\n", ".", " ", "")
OCR_BELOW = 50
FILENAME_LENGTH = 200
