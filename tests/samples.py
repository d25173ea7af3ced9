"""Small logs that are made of a rule.

Fixed values: the words, their groups of ten and the format of these lines, for which the groups' counts are known.
"""

import datetime

FORMAT = r"^(?P<timestamp>\d+-\d+-\d+T\d+:\d+:\d+)] (?P<message>.+)$"
LAYOUT = "2006-01-02T15:04:05"
FIRST = (("a", "a", "a"), ("b", "a", "a"), ("c", "a", "b"), ("d", "a", "b"), ("e", "a", "c"))
SECOND = (("f", "b", "c"), ("g", "b", "d"), ("h", "b", "d"), ("i", "b", "e"), ("j", "b", "e"))


def hourly(kinds, start="2024-10-01T00:00:00", first=1, each=10):
    """A line an hour: `each` of each kind, with words that no other line has."""
    at, out, k = datetime.datetime.fromisoformat(start), [], first
    for one, two, three in kinds:
        for _ in range(each):
            out.append(f"{at.isoformat()}] Com1, grp{one}10 Com2 (uniq){k:04d} grp{two}50 (uniq){k + 100:04d} <coM3> (uniq){k + 200:04d} grp{three}20 (uniq){k + 300:04d}")
            at, k = at + datetime.timedelta(hours=1), k + 1
    return out
