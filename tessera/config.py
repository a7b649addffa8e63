"""Labels, thresholds, markers and bins; all of them are defaults of parameters."""

from __future__ import annotations

FAKE, REAL = 0, 1
SEED = 42

# Agency names and patterns of publisher boilerplate, in the order they are taken out.
AGENCIES = "Reuters|Reuters Staff|AP|AFP|Bloomberg|CNN|BBC"
BOILERPLATE = (
    ("dateline", r"^\s*[A-Za-z][A-Za-z.\-/'’ ]{0,60}?\(\s*(?:" + AGENCIES + r")\s*\)\s*[-–—]+\s*"),
    ("agency tag", r"\(\s*(?:" + AGENCIES + r")\s*\)"),
    ("editor note", r"(?i)\((?:reporting|writing|editing|additional reporting)[^)]{0,300}\)|\b(?:reporting|writing|editing|additional reporting) by [^.;]{0,120}[.;]"),
    ("social", r"(?i)featured image via[^.]{0,120}\.?|image via[^.]{0,120}\.?|read more:.*?(?=\s[A-Z]|$)|pic\.twitter\.com/\S+|via\s+@\w+|\b21st century wire\b"),
    ("agency word", r"(?i)\b(?:reuters|thomson\s+reuters|associated\s+press|agence\s+france[-\s]presse)\b"),
)

# English stop words, the list that Apache Spark's StopWordsRemover has.
STOP_WORDS = tuple(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()
)

# Leakage markers, case-sensitive, ^ at line starts.
MARKERS = {
    "(Reuters) tag": r"\(\s*Reuters\s*\)",
    "word 'reuters'": r"\breuters\b",
    "wire dateline (CITY (Agency) -)": r"^[A-Z][A-Za-z.\-/'’ ]{0,40}\(\s*\w+\s*\)\s*[-–—]",
    "'Reporting by ...'": r"\bReporting by\b",
    "'Featured image via'": r"featured image via",
    "'READ MORE:'": r"READ MORE:",
    "pic.twitter.com link": r"pic\.twitter\.com",
    "'21st Century Wire'": r"21st Century Wire",
    "@mention": r"(?:^|\s)@\w+",
    "ALL-CAPS run (4+ words)": r"(?:\b[A-Z]{2,}\b[ ,]+){3}\b[A-Z]{2,}\b",
}

# Bins, left-closed for lengths and coverage, right-closed for confidence.
LENGTH_BINS = ((0, "<50"), (50, "50-199"), (200, "200-499"), (500, "500-999"), (1000, "1000+"))
COVERAGE_BINS = ((0, "<10"), (10, "10-24"), (25, "25-49"), (50, "50-99"), (100, "100-199"), (200, "200+"))
CONFIDENCE_BINS = ((0.6, "0.5-0.6"), (0.7, "0.6-0.7"), (0.8, "0.7-0.8"), (0.9, "0.8-0.9"), (1.0, "0.9-1.0"))

# Fixed values: (warn above, fail from) by check.
THRESHOLDS = {
    "empty_rate": (0.001, 0.05),
    "dup_rate": (0.01, 0.05),
    "dup_title_rate": (0.02, 0.10),
    "near_dup_rate": (0.01, 0.05),
    "shared_opening_rate": (0.01, 0.05),
    "unparseable_date_rate": (0.0, 0.01),
    "url_title_rate": (0.0, 0.005),
    "encoding_bad_rate": (0.001, 0.01),
    "short_article_rate": (0.01, 0.05),
    "formatting_rate": (0.002, 0.02),
    "subject_purity": (0.80, 0.99),
    "marker_class_gap": (0.20, 0.50),
    "ks_stat": (0.10, 0.25),
    "js_distance": (0.30, 0.50),
    "single_class_month": (0.05, 0.20),
}
# Points of a status; INFO does not count.
POINTS = {"PASS": 1.0, "WARN": 0.5, "FAIL": 0.0}
# Formats of dates, tried in this order.
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d-MMM-yy")
