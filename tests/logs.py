"""Logs for the tests: random ones, and words whose letters are activities a minute apart."""

import random
from datetime import datetime, timedelta

BEGIN = datetime(2021, 3, 8)
SCHEMA = "case_id string, event_index long, activity string, timestamp timestamp, resource string, outcome string"


def frame(spark, rows):
    """rows: (case, index, activity, seconds from BEGIN, resource, outcome); shuffled."""
    rows = [(c, i, a, BEGIN + timedelta(seconds=t), r, o) for c, i, a, t, r, o in rows]
    random.Random(len(rows)).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def drawn(seed, cases=60, alphabet="HIJKL", longest=9, outcomes=("kept", "sold", None), resources=("ann", "bo", "cy", None)):
    """Random cases with gaps in their places and ties in their times."""
    draw, rows = random.Random(seed), []
    for k in range(cases):
        at, place, outcome = draw.randrange(10**6), 0, draw.choice(outcomes)
        for _ in range(draw.randrange(1, longest + 1)):
            rows.append((f"k{k:03d}", place, draw.choice(alphabet), at, draw.choice(resources), outcome))
            at, place = at + draw.choice([0, 0, 60, 3600, draw.randrange(10**5)]), place + draw.randrange(1, 4)
    return rows


def spelled(words, minute=60):
    """words: (word, times); each its own case, in this order."""
    rows, k = [], 0
    for word, times in words:
        for _ in range(times):
            rows += [(f"w{k:04d}", i, a, 86400 * k + i * minute, None, None) for i, a in enumerate(word)]
            k += 1
    return rows


def by_case(rows):
    """case to its (activity, seconds) in order."""
    out = {}
    for c, i, a, t, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(c, []).append((a, t))
    return out


def hops(rows):
    """(activity, next) to the (case, seconds between) of each time it happened."""
    out = {}
    for c, events in by_case(rows).items():
        for (a, t), (b, u) in zip(events, events[1:]):
            out.setdefault((a, b), []).append((c, u - t))
    return out
