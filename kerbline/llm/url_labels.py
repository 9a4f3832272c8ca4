"""A small labelled table of addresses, built by a rule from words in made-up site names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Words in the names of sites that a crawl should leave out, and of sites that it should keep.
BLOCKED = (
    "casino", "poker", "slots", "jackpot", "bets", "betting", "roulette", "lottery", "pills", "meds", "viagra", "steroids", "adult", "porn", "xxx",
    "escort", "ads", "adserver", "banner", "track", "tracker", "clicks", "spam", "phishing", "malware", "warez", "crack", "payday", "loans",
    "replica", "cheap", "free", "win", "prizes",
)
KEPT = (
    "river", "north", "open", "old", "green", "winter", "city", "stone", "light", "music", "school", "history", "weather", "garden", "kitchen",
    "travel", "science", "health", "library", "book", "radio", "museum", "photo", "letter", "station", "mountain", "valley", "ocean", "forest",
    "coffee", "bread", "village", "nature", "planet", "teacher", "student", "theatre", "doctor", "culture", "thing", "three", "other", "there",
    "house", "hand", "action", "table", "read", "change", "people", "window", "question", "line", "earth", "thought",
)
#: What both kinds of names go on with.
ENDINGS = ("online", "now", "club", "zone", "world", "hub", "place", "notes")
BLOCKED_EACH, KEPT_EACH = 6, 6
_BEFORE = ("", "www.", "m.", "blog.")
_AFTER = (".example.com", ".example.org", ".example.net")
_PATHS = ("/en/12", "/de/7.html", "/fr/101?page=2", "/es/33/", "/en/940#top")


def labelled_addresses() -> list[tuple[str, int]]:
    """(url, blocked). Endings, hyphens, prefixes, domains and paths go round in both kinds alike and tell nothing."""
    rows = []
    for blocked, words, each in ((1, BLOCKED, BLOCKED_EACH), (0, KEPT, KEPT_EACH)):
        for i, word in enumerate(words):
            for k in range(each):
                at = i + 3 * k
                name = word + ("-", "")[(i + k) % 2] + (ENDINGS[at % len(ENDINGS)] if k % 3 else words[(7 * at + 5) % len(words)] if blocked == 0 else ENDINGS[(at + 3) % len(ENDINGS)])
                rows.append((f"https://{_BEFORE[at % 4]}{name}{_AFTER[at % 3]}{_PATHS[at % 5]}", blocked))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_addresses(), "url string, blocked int")
