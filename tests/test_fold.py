"""The closed form of the layer fold against a sequential fold."""

import random

import pytest

from granary.operators import fold

NAMES = ["a", "b", "c"]


def sequential(entries):
    """path -> (seq, item, origin); None if an entry is invalid."""
    tree = {"/": ((-1, -1), "dir", None)}
    drop = lambda p, own: [tree.pop(q) for q in list(tree) if q.startswith(p.rstrip("/") + "/") and q != "/" or (own and q == p)]
    for layer, n, path, item, target in entries:
        seq, (above, _, name) = (layer, n), path.rpartition("/")
        above = above or "/"
        if path == "/":
            if item != "dir":
                return None
            tree["/"] = (seq, item, None)
            continue
        if tree.get(above, (0, 0))[1] != "dir":
            return None
        if name == ".wh..wh..opq":
            drop(above, False)
        elif name.startswith(".wh."):
            drop(above.rstrip("/") + "/" + name[4:], True)
        else:
            origin = None
            if item == "hardlink":
                if target not in tree or tree[target][1] == "dir":
                    return None
                origin = tree[target][2] or tree[target][0]
            if item != "dir" or tree.get(path, (0, "leaf"))[1] != "dir":
                drop(path, True)
            tree[path] = (seq, item, origin)
    tree.pop("/") if tree["/"][0] == (-1, -1) else None
    return tree


def batch(rnd):
    out = []
    while len(out) < rnd.randrange(3, 25):
        depth = rnd.randrange(1, 4)
        path = "/" + "/".join(rnd.choice(NAMES) for _ in range(depth))
        kind = rnd.choices(["dir", "leaf", "wh", "opq", "hardlink"], [5, 3, 2, 1, 2])[0]
        above = path.rpartition("/")[0]
        layer = out[-1][0] + (rnd.random() < 0.2) if out else 0
        entry = {
            "dir": (path, "dir", None),
            "leaf": (path, "leaf", None),
            "wh": (f"{above}/.wh.{rnd.choice(NAMES)}", "leaf", None),
            "opq": (f"{above}/.wh..wh..opq", "leaf", None),
            "hardlink": (path, "hardlink", "/" + "/".join(rnd.choice(NAMES) for _ in range(rnd.randrange(1, 3)))),
        }[kind]
        row = (layer, len(out), *entry)
        if sequential([*out, row]) is not None:
            out.append(row)
    return out


@pytest.fixture(scope="module")
def batches():
    rnd = random.Random(7)
    return [batch(rnd) for _ in range(120)]


def test_closed_form_equals_sequential_fold(spark, batches):
    # All batches are one forest: each has a directory of its own.
    rows, want, links = [], {}, {}
    for k, entries in enumerate(batches):
        root = f"/r{k}"
        rows.append((0, -1 - k, root, "dir", None))
        for layer, n, path, item, target in entries:
            rows.append((layer, n + 1000 * k, root + path, item, root + target if target else None))
        for path, (seq, item, origin) in sequential(entries).items():
            want[root + path] = (item, seq[0], seq[1] + 1000 * k)
        tree = sequential(entries)
        for path, (seq, item, origin) in tree.items():
            if item == "hardlink":
                links[(seq[0], seq[1] + 1000 * k)] = (origin[0], origin[1] + 1000 * k)
    frame = spark.createDataFrame(rows, "layer_idx int, entry_idx long, path string, item string, target string")
    got = {r.path: (r.item, r.layer_idx, r.entry_idx) for r in fold.folded(frame).collect() if r.path.count("/") > 1}
    assert got == want
    found = {(r.layer_idx, r.entry_idx): (r.origin_layer, r.origin_entry) for r in fold.origins(frame).collect()}
    assert links and all(found[k] == v for k, v in links.items())
    assert fold.invalid(frame).count() == 0


CASES = {
    "file": (["/etc", "/etc/hosts=", "/etc/passwd=", "/etc/.wh.hosts="], ["/etc", "/etc/passwd"]),
    "missing target": (["/etc", "/etc/.wh.nosuchfile="], ["/etc"]),
    "directory": (["/usr", "/usr/local", "/usr/local/x=", "/usr/.wh.local="], ["/usr"]),
    "opaque": (["/etc", "/etc/a=", "/etc/b", "/etc/b/c=", "/etc/.wh..wh..opq="], ["/etc"]),
    "opaque then add": (["/etc", "/etc/a=", "/etc/.wh..wh..opq=", "/etc/n="], ["/etc", "/etc/n"]),
    "odd names": (["/a=", "/.wh..wh.=", "/.wh.="], ["/a"]),
    "recreate": (["/a=", "/.wh.a=", "/a="], ["/a"]),
    "directory over file": (["/a=", "/a", "/a/b="], ["/a", "/a/b"]),
    "file over directory": (["/a", "/a/b=", "/a="], ["/a"]),
    "directory over directory": (["/a", "/a/b=", "/a"], ["/a", "/a/b"]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    given, want = CASES[name]
    rows = [(0, k, p.rstrip("="), "leaf" if p.endswith("=") else "dir", None) for k, p in enumerate(given)]
    frame = spark.createDataFrame(rows, "layer_idx int, entry_idx long, path string, item string, target string")
    assert sorted(r.path for r in fold.folded(frame).collect()) == want


def test_invalid_entries_are_found(spark):
    rows = [
        (0, 0, "/a", "leaf", None),
        (0, 1, "/a/b", "leaf", None),
        (0, 2, "/c", "dir", None),
        (0, 3, "/.wh.c", "leaf", None),
        (1, 0, "/c/d", "leaf", None),
        (1, 1, "/", "leaf", None),
    ]
    frame = spark.createDataFrame(rows, "layer_idx int, entry_idx long, path string, item string, target string")
    assert sorted((r.layer_idx, r.entry_idx) for r in fold.invalid(frame).collect()) == [(0, 1), (1, 0), (1, 1)]


def test_origins_of_long_chains_of_links(spark):
    rows = [(0, 0, "/f", "leaf", None)] + [(0, k, f"/l{k}", "hardlink", f"/l{k - 1}" if k > 1 else "/f") for k in range(1, 67)]
    found = fold.origins(spark.createDataFrame(rows, "layer_idx int, entry_idx long, path string, item string, target string")).collect()
    assert {(r.entry_idx, r.origin_entry) for r in found} == {(k, 0) for k in range(1, 67)}
