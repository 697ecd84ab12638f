"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, hints, rules and their order decide the results.
TOKEN = r"[A-Za-z][A-Za-z0-9+/#.&'-]*"
INJECTION = (
    r"(?i)(ignore\s+(all\s+)?(previous|prior|above)\s+instructions?|disregard\s+(all\s+)?(previous|prior|above)\s+instructions?|new\s+instructions?:|system\s*prompt:|"
    r"you\s+are\s+now\s+(a|an)\s+|act\s+as\s+(a|an)\s+|forget\s+(your\s+)?(previous|prior)\s+instructions?|<\s*/?system\s*>|<\s*/?instructions?\s*>)"
)
REMOVED = "[CONTENT REMOVED: matched injection pattern]"
QUERY_CLASSES = [
    ("doctrine", ["watch out situations", "what does doctrine", "what does irpg", "what is lces", "what are the standard fire orders", "according to nwcg"]),
    ("safety-critical", ["risk", "safety", "hazard", "east flank", "escape route", "safety zone", "watch out", "urgent"]),
    ("incident+doctrine synthesis", ["what strategy", "what tactics", "containment strategy", "next steps", "what makes sense here", "recommend", "how should", "what approach"]),
    (
        "incident-fact",
        ["what resources", "assigned resources", "who is the ic", "containment", "weather", "location", "operational period", "what is the fire behavior",
         "where is the fire going", "where will the fire go", "where will the fire spread", "which direction is the fire moving", "which direction will it spread", "spread direction", "predicted spread"],
    ),
]
UNCLEAR = "unclear / missing data"
SECTION_HINTS = [
    ("Weather", ["weather", "wind", "humidity", "forecast"]),
    ("Resources", ["resources", "assigned", "engines", "crews", "aircraft"]),
    ("Safety Concerns", ["safety", "risk", "hazard", "watch out", "lces"]),
    ("Operations Plan", ["strategy", "tactics", "containment", "operations", "plan"]),
    ("Command Structure", ["command", "ic", "operations section chief", "divs"]),
    ("Values at Risk", ["values at risk", "structures", "wui", "exposure"]),
    ("Current Situation", ["fire behavior", "situation", "spread", "current"]),
]
SECTION_BONUS, AUTHORITY_BONUS, REPORT_BONUS = 0.35, 0.03, 0.2
DOMAINS = [
    ("aviation", ["aviation", "helicopter", "airtanker", "retardant", "helispot", "aircraft", "uas"]),
    ("medical", ["medical", "triage", "burn injuries", "cpr", "fatality", "casualty"]),
    ("safety", ["safety", "watch out", "lces", "hazard", "lookout", "survival", "stress", "risk"]),
    ("command", ["command", "planning", "logistics", "finance", "coordination", "communications", "leadership", "unified command"]),
    ("fire_behavior", ["fire behavior", "fire environment", "weather", "fuel", "smoke", "windspeed"]),
    ("wui", ["wildland urban interface", "wui", "structure protection"]),
    ("doctrine", ["policy", "doctrine", "standards", "organization", "responsibilities", "program"]),
]
TOPICS = [
    ("lces", ["lces"]),
    ("watch out situations", ["watch out", "18 watch out", "watchout"]),
    ("risk management", ["risk management", "risk", "hazard mitigation"]),
    ("aviation", ["aviation", "airtanker", "helicopter", "aircraft", "uas", "helispot"]),
    ("medical", ["medical", "triage", "medevac", "ems", "injury", "burn"]),
    ("incident command system", ["incident command system", "ics", "incident commander"]),
    ("communications", ["communications", "radio", "frequency", "dispatch"]),
    ("fire behavior", ["fire behavior", "smoke column", "windspeed", "weather", "fuel moisture"]),
    ("wui", ["wildland urban interface", "wui", "structure protection"]),
    ("leadership", ["leader", "leadership", "commander's intent", "leader’s intent"]),
    ("preparedness", ["preparedness", "pre-position", "mobilization", "readiness"]),
    ("suppression", ["suppression", "direct attack", "indirect attack", "fireline"]),
]
# Sections of an incident report and the headings that open them, in order of precedence.
SECTIONS = {
    "Incident Overview": ["incident overview", "overview", "incident summary", "incident information", "situation summary"],
    "Current Situation": [
        "current situation", "current fire behavior", "situation", "fire behavior", "current conditions", "situation update", "environmental & fire behavior inputs",
        "environmental and fire behavior inputs", "derived fire behavior metrics", "derived fire behavior metrics simulated",
    ],
    "Weather": ["weather", "forecast", "fire weather", "current weather"],
    "Resources": ["resources", "assigned resources", "organization", "resource summary"],
    "Objectives": ["objectives", "control objectives", "incident objectives"],
    "Safety Concerns": ["safety concerns", "hazards", "watch out", "risk", "hazard mitigation", "critical safety message"],
    "Operations Plan": ["operations plan", "strategy", "tactics", "operations", "planned actions", "rl agent recommendation", "operational implications"],
    "Command Structure": ["command structure", "command", "organization assignment", "ics organization"],
    "Values at Risk": ["values at risk", "values threatened", "exposures", "assets at risk"],
    "Terrain": ["terrain"],
    "Fuels": ["fuels", "fuel conditions"],
}
# Facts of an incident: (key, label, labels in a report).
FACTS = [
    ("incident_name", "Incident Name", ["incident name", "fire name", "incident"]),
    ("operational_period", "Operational Period", ["operational period", "op period", "shift", "period"]),
    ("location", "Location", ["location", "region", "jurisdiction", "unit", "division", "branch"]),
    ("overall_risk_level", "Overall Risk Level", ["overall risk level", "overall_risk_level", "risk level", "incident risk level"]),
    ("current_fire_behavior", "Current Fire Behavior", ["current fire behavior", "fire behavior", "situation", "current situation"]),
    ("containment", "Containment", ["containment", "percent contained", "% contained"]),
    ("weather", "Weather", ["weather", "forecast", "wind", "relative humidity", "humidity"]),
    ("fuels", "Fuels", ["fuels", "fuel conditions"]),
    ("terrain", "Terrain", ["terrain", "slope", "aspect", "drainage"]),
    ("values_at_risk", "Values at Risk", ["values at risk", "values threatened", "structures threatened", "critical infrastructure"]),
    ("strategy_tactics", "Strategy / Tactics", ["strategy", "tactics", "planned actions", "operations plan"]),
    ("assigned_resources", "Assigned Resources", ["resources", "assigned resources", "personnel", "engines", "crews", "aircraft"]),
    ("safety_concerns", "Safety Concerns", ["safety concerns", "hazards", "critical safety", "watch out"]),
    ("command_structure", "Command Structure", ["command structure", "incident commander", "operations section chief", "command"]),
    ("unresolved_risks", "Unresolved Risks", ["unresolved risks", "outstanding concerns", "issues", "constraints"]),
]
NO_HEADINGS = ["table of contents", "this page intentionally left blank.", "this page left intentionally blank.", "acknowledgments", "appendix", "glossary/acronyms"]
DASHES = "‐‑‒–—−"


def squeeze(x: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    """Lower-case tokens that start with a letter, without ., _ and - at their ends."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.btrim(F.lower(t), F.lit("._-")))


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def norm(x: Column) -> Column:
    """Dashes to -, lower case, white space to single spaces.

    Each letter is one in lower case too, whatever stands beside it, so that a part of a text is a part of what it becomes:
    lower() alone writes a sigma otherwise at the end of a word, and a dotted I as two characters.
    """
    return squeeze(F.lower(F.translate(x, DASHES + "Σİ", "-" * len(DASHES) + "σi")))


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def first_match(x: Column, rules: list[tuple[str, list[str]]], default: Column) -> Column:
    """The name of the first rule one of whose words is in the lower-case text."""
    low = F.lower(x)
    out = None
    for name, words in rules:
        out = F.when(_any(low, words), name) if out is None else out.when(_any(low, words), name)
    return out.otherwise(default)


def classify(x: Column) -> Column:
    return first_match(x, QUERY_CLASSES, F.lit(UNCLEAR))


def hinted_sections(query: Column) -> Column:
    """Names of the sections that a query hints at."""
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in SECTION_HINTS]))


def chunk_bonus(authority_rank: Column, source_type: Column) -> Column:
    """What a chunk gains whatever is asked: by the rank of its authority, and as part of an incident report."""
    return F.coalesce(authority_rank, F.lit(0)) * AUTHORITY_BONUS + F.when(source_type == "incident_report", REPORT_BONUS).otherwise(0.0)


def topic_tags(path: Column, text: Column, domain: Column) -> Column:
    """The domain, then each topic found in path and text that isn't there yet."""
    low = F.lower(F.concat_ws(" ", path, text))
    found = [F.when(_any(low, words), F.lit(name)) for name, words in TOPICS]
    return F.array_distinct(F.concat(F.array(domain), F.array_compact(F.array(*found))))


def sanitize(x: Column) -> Column:
    """Lines that match an injection pattern are replaced by a marker."""
    return F.array_join(F.transform(F.split(x, r"\R"), lambda line: F.when(F.rlike(line, F.lit(INJECTION)), F.lit(REMOVED)).otherwise(line)), "\n")


def clean_heading(x: Column) -> Column:
    for pattern in (r"\.{2,}\s*[A-Za-z0-9\-]+$", r"\s+\b[ivxlcdmIVXLCDM]+$", r"\s+SM\s+\d+-\d+$", r"\s+\d+-\d+$"):
        x = F.regexp_replace(squeeze(x), pattern, "")
    return F.btrim(x, F.lit(" :-"))


_CAPS = r"^[A-Z][A-Z0-9/&(),'\- ]+$"


def is_heading(t: Column) -> Column:
    """Whether a line cleaned by clean_heading is short, without a bullet or final punctuation, and a chapter, in capitals, or in title case."""
    words = F.size(F.split(t, r"\s+"))
    titled = F.filter(F.split(t, r"[\s/]+"), lambda w: F.rlike(w, F.lit(r"\p{L}")))
    title_case = (F.size(titled) > 0) & F.forall(F.slice(titled, 1, 10), lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    fits = (F.length(t) > 0) & (F.length(t) <= 130) & (words <= 18) & ~F.rlike(t, F.lit(r"^[•\-*]")) & ~F.rlike(t, F.lit(r"[.!?;]$")) & ~F.lower(t).isin(NO_HEADINGS)
    return fits & (F.rlike(t, F.lit(r"(?i)^(chapter|unit)\s+\d+")) | (F.rlike(t, F.lit(_CAPS)) & (words <= 14)) | title_case)


def is_chapter_alone(t: Column) -> Column:
    """Whether a line cleaned by clean_heading is the label of a chapter without its title."""
    return F.rlike(t, F.lit(r"(?i)^(chapter|unit)\s+\d+\s*$"))


def is_contents(page: Column) -> Column:
    """Whether a page is a table of contents."""
    low = F.lower(page)
    return F.contains(low, F.lit("table of contents")) & (F.regexp_count(low, F.lit("chapter")) + F.regexp_count(low, F.lit("unit")) >= 2)


def first_text(*texts: Column) -> Column:
    """The first of the texts that isn't empty, with single spaces; empty if none is."""
    return F.coalesce(*[F.when(F.length(x) > 0, squeeze(x)) for x in texts], F.lit(""))


def incident_id(name: Column, at: Column) -> Column:
    """The slug of a name and the date (UTC) of a time."""
    return F.concat(slug(name), F.lit("_"), F.date_format(at, "yyyy_MM_dd"))


def heading_level(t: Column) -> Column:
    """1 to 3, of a line cleaned by clean_heading."""
    top = F.rlike(t, F.lit(r"(?i)^(chapter|unit)\s+\d+")) | F.rlike(t, F.lit(_CAPS))
    return F.when(top, 1).when(F.size(F.split(t, r"\s+")) <= 6, 2).otherwise(3)


def compact(x: Column, most: int, marker: str = " ... ") -> Column:
    """Head and tail of a text that is longer than `most`."""
    half = (most - len(marker)) // 2
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, half), F.lit(marker), F.right(x, F.lit(half)))).otherwise(x)


def json_object(x: Column) -> Column:
    """From the first { to the last } of a text; null if there is none."""
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def score(x: Column) -> Column:
    """A number with 4 places; null for null, blank and other texts."""
    return F.round(F.trim(x).try_cast("double"), 4)
