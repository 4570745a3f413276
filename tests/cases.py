"""Small event tables with everything that is dirty in them, and how records are read, in plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

EVENT_SCHEMA = "user_uid string, timestamp timestamp, event_type string, url string, entity string, cell long, us long, kind string, key string, salt int, n long"
START = datetime(2014, 10, 1, tzinfo=timezone.utc)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
NIL = "00000000-0000-0000-0000-000000000000"


def user(i: int) -> str:
    return f"{i:08x}-7d31-4c11-8a55-00c0a51de5ed"


def spelled(rng: random.Random, uid: str) -> str:
    return rng.choice([uid, uid.upper(), f" {uid}", f"{uid}  ", uid.replace("-", ":"), uid.replace("-", "_")])


def dirty_events(seed: int = 1, n: int = 600, users: int = 9, days: int = 4) -> list[tuple]:
    """Rows of EVENT_SCHEMA; a third of them of one user; ties, repeats, nulls, unusable users, missing times."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        uid = user(0) if rng.random() < 0.34 else user(rng.randrange(users))
        shown = rng.choice([None, "", "null", NIL, "not-a-user"]) if rng.random() < 0.08 else spelled(rng, uid)
        when = START + timedelta(milliseconds=rng.choice([rng.randrange(days * 86_400_000), rng.randrange(40) * 1_800_000]))
        when = rng.choice([None, EPOCH]) if rng.random() < 0.06 else when
        kind = rng.choice(["Page", "page ", " page", "click", "buy", None, ""])
        url = rng.choice(["a.com", "b.com", "c.com/" + "x" * 50, None, ""])
        rows.append((shown, when, kind, url, "clash", 1, 2, "clash", "clash", 3, 4))
    rows += [rng.choice(rows) for _ in range(n // 10)]  # exact repeats
    rng.shuffle(rows)
    return rows


def records(rows: list[tuple]) -> set[tuple]:
    """(user, microseconds or None, type or None, url) of each record once."""
    found = set()
    for shown, when, kind, url, *_ in rows:
        text = (shown or "").strip(" ")
        parts = [text[a : a + n].lower() for a, n in ((0, 8), (9, 4), (14, 4), (19, 4), (24, 12))]
        uid = "-".join(parts)
        if len(text) != 36 or uid == NIL or any(c not in "0123456789abcdef" for p in parts for c in p):
            continue
        us = None if when in (None, EPOCH) else (when - EPOCH) // timedelta(microseconds=1)
        found.add((uid, us, (kind or "").strip(" ").lower() or None, url))
    return found
