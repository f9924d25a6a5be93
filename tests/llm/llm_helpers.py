"""Small tables with every odd case, and brute-force components."""

SF = "/root/testdata/sf0.001"

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size int, fp string, component_id string, key string, kept string, _x string")


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) in a table with clashing extra columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0",
             None if r[1] is None else len(r[1]), 1, "f", "c", "k", "x", "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977} the{i % 31}" for i in range(20_000)) + "."
PARA = ("The first line of a passage that is long enough to be a run of its own here. "
        "And a second sentence follows it with quite a few words more to make it whole. ")


def odd_rows():
    """Nulls, empties, blanks, a long text, repeated rows and copies."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PARA * 2), (6, PARA * 2),
            (6, PARA * 2), (None, PARA), (None, None), (7, "One."), (8, "x" * 30_000),
            (9, "Ünïcode ﬁne 漢字 🙂 \x1c\x85  tail"), (10, LONG + " End")]


def components(nodes, links):
    """Smallest node reachable, by union-find."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
