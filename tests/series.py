"""Series for tests, as a first time and steps of time:value."""

from __future__ import annotations


def points(text: str, kind=int) -> list[list]:
    """'100 0:5 3:7' is 5 at 100 and 7 at 103."""
    first, *rest = text.split()
    out = []
    for part in rest:
        step, value = part.split(":", 1)
        out.append([int(first) + int(step), kind(value)])
    return out


T = 1471254705
AGGR = points("1447249033 0:531 304:534 600:535 904:531 1216:532 1516:537 1835:530 2135:520 2416:54 2716:54 3016:513 3316:537 3616:528 3935:531 4211:533 4516:538 4816:534 5116:532 5416:533 5715:537")
DATA = {
    "series-001 float": points(f"{T} 0:1.5 2:-3.5 5:-7.3", float),
    "series-002 float": points(f"{T} 0:3.5 2:-2.5 5:-8.3", float),
    "series-001 integer": points(f"{T} 0:5 3:-3 5:-7"),
    "series-002 integer": points(f"{T} 0:4 3:-1 5:-8"),
    "aggr": AGGR,
    "huge": [[T + k, (1 << 63) - 1 - k] for k in range(4)],
    "equal ts": points(f"{T} 0:0 0:1 0:1 2:0 2:1 3:0"),
    "variance": points(f"{T} 0:2.75 1:1.75 2:1.25 3:0.25 4:0.5 5:1.25 6:3.5", float),
    "pvariance": points(f"{T} 0:0 1:0.25 2:0.25 3:1.25 4:1.5 5:1.75 6:2.75 7:3.25", float),
    "filter": points(f"{T} 0:5 5:-3 10:-7 15:7"),
    "one": points(f"{T} 5:1"),
    "log": [[T + 5 + 2 * k, text] for k, text in enumerate(("log line one", "log line two", "another line (three)", "and yet one more"))],
    "special": points(f"{T} 0:0.1 1:nan 2:inf 3:-inf", float),
}
