"""Word lists the results depend on."""

from __future__ import annotations

# ---- fixed values -----------------------------------------------------------

# English stop words of three letters or more; shorter ones are left out, since no term is that short.
STOP_WORDS = """
about above across after afterwards again against all almost alone along already also although always among
amongst amoungst amount and another any anyhow anyone anything anyway anywhere are around back became
because become becomes becoming been before beforehand behind being below beside besides between beyond bill
both bottom but call can cannot cant con could couldnt cry describe detail done down due during each eight
either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few
fifteen fifty fill find fire first five for former formerly forty found four from front full further get
give had has hasnt have hence her here hereafter hereby herein hereupon hers herself him himself his how
however hundred inc indeed interest into its itself keep last latter latterly least less ltd made many may
meanwhile might mill mine more moreover most mostly move much must myself name namely neither never
nevertheless next nine nobody none noone nor not nothing now nowhere off often once one only onto other
others otherwise our ours ourselves out over own part per perhaps please put rather same see seem seemed
seeming seems serious several she should show side since sincere six sixty some somehow someone something
sometime sometimes somewhere still such system take ten than that the their them themselves then thence
there thereafter thereby therefore therein thereupon these they thick thin third this those though three
through throughout thru thus together too top toward towards twelve twenty two under until upon very via was
well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
whether which while whither who whoever whole whom whose why will with within without would yet you your
yours yourself yourselves
""".split()

LOW_SIGNAL_TERMS = [
    "new", "using", "time", "latest", "based", "used", "use", "like",
    "said", "says", "year", "years", "week", "today", "make", "made",
    "usd", "billion", "million", "trillion", "percent", "including",
    "included", "report", "news", "analysis", "results", "quarter",
    "just", "also", "well", "first", "second", "third", "fourth",
    "number", "numbers", "data", "source", "sources", "according",
]

GENERIC_LABEL_TERMS = [
    "technology", "technologies", "system", "systems", "platform", "platforms",
    "solution", "solutions", "service", "services", "industry", "market",
    "global", "company", "companies", "business", "west", "east",
]

LABEL_ACRONYMS = ["ai", "ml", "nlp", "ros"]

VAGUE_TERMS = ["innovation", "future", "technology", "tech", "startup", "startups", "market"]

GENERIC_TOPICS = {
    "ai": ["AI productivity tools", "AI startups", "enterprise AI automation"],
    "artificial intelligence": ["AI productivity tools", "AI startups", "enterprise AI automation"],
    "robotics": ["humanoid robotics", "warehouse robotics", "robotics computer vision"],
    "finance": ["fintech infrastructure", "retail investing platforms", "AI in finance"],
    "healthcare": ["AI diagnostics", "digital therapeutics", "healthcare operations automation"],
    "energy": ["grid storage", "solar software", "industrial electrification"],
    "marketing": ["performance marketing", "brand strategy", "content marketing trends"],
    "hr": ["talent acquisition trends", "employee engagement", "future of work"],
    "sales": ["B2B sales strategies", "sales automation", "revenue operations"],
    "sustainability": ["ESG investing", "carbon markets", "sustainable supply chain"],
    "crypto": ["DeFi protocols", "blockchain enterprise", "crypto regulation"],
    "edtech": ["online learning platforms", "corporate training", "skills gap"],
}

GENERIC_SUGGESTIONS = ["industry trends", "startups", "enterprise applications"]

QUERY_SUFFIXES = [
    "latest trends 2026",
    "industry news and developments",
    "market growth and key players",
    "technology innovations",
]

RETRY_SUFFIX = " latest news developments market"

POSITIVE_LEXICON = {
    "growth": 2, "grow": 1, "soar": 2, "surge": 2, "boom": 2, "accelerat": 2,
    "expand": 1, "scale": 1, "momentum": 2, "outperform": 2,
    "innovat": 2, "breakthrough": 2, "launch": 1, "pioneer": 2, "disrupt": 1,
    "transform": 1, "revolutioniz": 2, "advance": 1, "cutting-edge": 2, "state-of-the-art": 2,
    "profit": 2, "revenue": 1, "gain": 1, "record": 1, "invest": 1, "fund": 1,
    "unicorn": 2, "ipo": 1, "valuation": 1, "roi": 1,
    "hire": 1, "hiring": 2, "recruit": 1, "talent": 1, "promot": 1,
    "excit": 2, "proud": 2, "thrilled": 2, "delighted": 2, "honor": 1,
    "optimis": 2, "confident": 1, "success": 2, "achiev": 2, "win": 2,
    "award": 2, "recogni": 1, "celebrat": 1,
    "partner": 1, "collaborat": 1, "opportunit": 2, "adoption": 2, "leading": 1,
    "robust": 1, "efficient": 1, "improve": 1, "enhanc": 1, "empower": 1,
    "best": 1, "top": 1, "strong": 1, "excel": 2,
}

NEGATIVE_LEXICON = {
    "layoff": 3, "laid off": 3, "job loss": 3, "redundan": 3, "retrench": 3,
    "downsize": 2, "furlough": 2,
    "loss": 2, "declin": 2, "drop": 1, "fall": 1, "shrink": 2, "plummet": 3,
    "bankrupt": 3, "debt": 1, "deficit": 2, "cut": 1,
    "risk": 1, "threat": 2, "vulnerab": 2, "breach": 3, "hack": 3, "fraud": 3,
    "exploit": 2, "attack": 2, "leak": 2, "scam": 3,
    "crisis": 3, "crash": 3, "collaps": 3, "fail": 2, "shut down": 2,
    "concern": 1, "challeng": 1, "problem": 1, "difficult": 1, "uncertain": 1,
    "regulat": 1, "fine": 1, "lawsuit": 2, "litigat": 2, "penalt": 2,
    "bias": 2, "discriminat": 2, "unethic": 3, "mislead": 2, "manipulat": 3,
    "toxic": 2, "harmful": 2, "dangerous": 2, "controversial": 1,
    "displace": 2, "replac": 1, "automat": 1,
    "fear": 2, "warn": 1, "slow": 1, "poor": 2, "weak": 1,
}

NEGATORS = ["not", "no", "never", "without", "lack", "lacking", "fails", "failed"]
INTENSIFIERS = ["very", "extremely", "highly", "incredibly", "massively", "significantly"]

REGIONS = ["india", "asia_pacific", "southeast_asia", "north_america", "europe", "middle_east"]

# ---- end of fixed values ----------------------------------------------------


def sql_list(words) -> str:
    """Words as the inside of a SQL IN list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def stop_words() -> tuple[str, ...]:
    """The default of every ``stop_words`` parameter."""
    return tuple(STOP_WORDS)
