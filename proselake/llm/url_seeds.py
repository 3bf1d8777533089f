"""Labelled URLs from which the URL trees learn by default, drawn by a rule: the tables hold none.

Label 1 is unwanted. Both kinds draw every part of a URL from the same forms (hosts with and without hyphens, paths, page
numbers, parameters, fragments); they differ in how often, and overlap in all: unwanted URLs tend to be longer and deeper, to
hold more digits, random tokens and parameters, and to end in suffixes that are seldom used otherwise. Any labelled table of
``url, blocked`` takes this one's place.
"""

from __future__ import annotations

import random

# What hosts are made of, and suffixes with the share of each kind's hosts that end in them.
WORDS = """library university museum weather railway history hospital theatre chess botany travel poetry garden atlas harbour
market studio casino bonus loans pills slots deals offers prizes dating coupon replica streams torrent lottery""".split()
SUFFIXES = {
    "com": (0.36, 0.30), "org": (0.20, 0.06), "net": (0.12, 0.12), "edu": (0.06, 0.00), "gov": (0.05, 0.00), "de": (0.08, 0.04), "fr": (0.06, 0.03),
    "info": (0.04, 0.12), "biz": (0.01, 0.07), "top": (0.01, 0.10), "xyz": (0.01, 0.09), "click": (0.00, 0.07),
}
TOKEN = "abcdefghijklmnopqrstuvwxyz0123456789"


def _url(rng: random.Random, kind: int) -> str:
    """One URL of a kind; every part is possible for either."""
    odds = lambda clean, unwanted: rng.random() < (clean, unwanted)[kind]
    token = lambda least, most: "".join(rng.choices(TOKEN, k=rng.randint(least, most)))
    labels = [rng.choice(WORDS) + ("-" + rng.choice(WORDS) if rng.random() < 0.4 else "") + (str(rng.randint(1, 999)) if odds(0.05, 0.4) else "")]
    if odds(0.05, 0.35):
        labels.insert(0, token(6, 14))
    if rng.random() < 0.4:
        labels.insert(0, rng.choice(["www", "m", "blog", "news"]))
    suffix = rng.choices(list(SUFFIXES), [share[kind] for share in SUFFIXES.values()])[0]
    parts = [rng.choice(["en", "fr", "de", "es", "item", "page"])] if odds(0.8, 0.8) else []
    while odds(0.35, 0.6) and len(parts) < 8:
        parts.append(token(4, 16) if odds(0.1, 0.5) else rng.choice(WORDS))
    parts.append(str(rng.randint(1, 999)) if odds(0.7, 0.4) else token(5, 20))
    url = f"{rng.choice(['http', 'https'])}://{'.'.join([*labels, suffix])}/{'/'.join(parts)}{rng.choice(['', '', '/', '.html'])}"
    asked = []
    while odds(0.3, 0.6) and len(asked) < 7:
        asked.append(f"{rng.choice(['page', 'ref', 'id', 'utm_source', 'q', 'sid'])}={token(8, 24) if odds(0.1, 0.6) else rng.choice(['1', '2', 'feed', 'x'])}")
    return url + ("?" + "&".join(asked) if asked else "") + ("#top" if rng.random() < 0.1 else "")


def seeds(each: int = 1500, seed: int = 5) -> list[tuple[str, int]]:
    """(url, blocked): ``each`` URLs of either kind."""
    rng = random.Random(seed)
    return [(_url(rng, kind), kind) for _ in range(each) for kind in (1, 0)]
