"""Hand-made transactions with the edge cases the look-back features must
handle: single-row entity, equal timestamps (also as the oldest pair), gaps
of exactly one day and exactly k days, equal values (deviation 0), values
whose mean is 0."""
from datetime import datetime, timedelta

T0 = datetime(2024, 3, 1, 12, 0, 0)


def edge_rows():
    rows = []
    rid = 0

    def add(card, dt, v, label=0):
        nonlocal rid
        rows.append((rid, card, dt, float(v), label))
        rid += 1

    # card 1: single row
    add("1", T0, 10)
    # card 2: oldest pair tied, then ties in the middle
    add("2", T0, 5)
    add("2", T0, 7)
    add("2", T0 + timedelta(hours=3), 9, 1)
    add("2", T0 + timedelta(hours=3), 1)
    add("2", T0 + timedelta(days=1, hours=3), 4)
    # card 3: gaps of exactly 1 day and exactly 3 days
    add("3", T0, 2)
    add("3", T0 + timedelta(days=1), 4)
    add("3", T0 + timedelta(days=2), 6, 1)
    add("3", T0 + timedelta(days=5), 8)
    add("3", T0 + timedelta(days=8), 8)
    add("3", T0 + timedelta(days=8, microseconds=1), 3)
    # card 4: all values equal
    for i in range(5):
        add("4", T0 + timedelta(hours=7 * i), 3)
    # card 5: values with mean 0
    for i, v in enumerate([2, -2, 4, -4, 0, 1]):
        add("5", T0 + timedelta(hours=11 * i, minutes=i), v)
    # card 6: long quiet period (history outside every interval)
    add("6", T0, 1)
    add("6", T0 + timedelta(days=20), 2)
    add("6", T0 + timedelta(days=20, hours=1), 3)
    return rows


SCHEMA = "id long, card string, ts timestamp, amount double, fraud int"
