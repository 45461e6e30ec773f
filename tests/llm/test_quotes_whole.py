import random
import re

import duckdb
import pytest

from plurality.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def normal(x):
    return re.sub(r"[\W_]+", " ", x.lower()).strip()


def brute(rows):
    """Every quoted run and line against everything said, message by message."""
    parsed = []
    for conv, turn, _, text in rows:
        runs = []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)+", line)
            level, own = (marks[0].count(">"), re.sub(r"^[ \t]", "", line[marks.end() :])) if marks else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(own)
            else:
                runs.append((level, [own]))
        parsed.append((conv, turn, [(level, "\n".join(x)) for level, x in runs]))
    said = {}
    for conv, turn, runs in parsed:
        if conv is not None and turn is not None:
            own = [x for level, x in runs if level == 0]
            for unit in [" ".join(own).strip(), "\n".join(own), *own, *[y for x in own for y in x.split("\n")]]:
                if normal(unit):
                    by = said.setdefault(normal(unit), {})
                    by[conv] = min(turn, by.get(conv, turn))
    out = []
    for conv, turn, runs in parsed:
        n, best = 0, None
        for level, x in [r for r in runs if r[0] > 0] if conv is not None and turn is not None else ():
            found = []
            for unit, whole in [(normal(x), True), *[(normal(y), False) for y in x.split("\n") if normal(y) != normal(x)]]:
                by = said.get(unit, {}) if unit else {}
                far = [c for c in by if c != conv] if len(unit) >= quotes.LEAST else []
                if by.get(conv, turn) < turn:
                    found.append((-level, True, whole, len(unit) >= quotes.LEAST, by[conv], conv))
                elif far:
                    c = min(far) if min(by) != conv else max(far)
                    found.append((-level, False, whole, True, by[c], c))
            n += bool(found)
            best = max([*found, *([best] if best else [])], default=None)
        out.append((conv, turn, sum(level > 0 for level, _ in runs), n, best and best[5], best and best[4]))
    return sorted(out, key=repr)


def columns(df):
    return sorted([tuple(r) for r in df.select("conv_id", "turn", "n_quoted", "n_linked", "parent_conv", "parent_turn").collect()], key=repr)


def invented(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("the bridge over northern road river stone is closed today and open".split()) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    rows = []
    for _ in range(220):
        parts = []
        for _ in range(rng.randint(1, 6)):
            mark = rng.choice(["", "", "> ", ">", "> > ", " >>\t", ">>> "])
            parts.append(mark + rng.choice(lines).upper() if rng.random() < 0.2 else mark + rng.choice(lines))
        rows.append((rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, *range(12)]), rng.choice("ua"), rng.choice(["\n".join(parts)] * 12 + ["", None])))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force_and_sql(spark, seed):
    rows = invented(seed)
    messages = spark.createDataFrame(rows, SCHEMA)
    assert columns(quotes.link_quotes(messages)) == brute(rows)
    con = duckdb.connect()
    con.register("conversations", messages.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = "conv_id, turn, role, max_level, n_quoted, n_linked, parent_conv, parent_turn, branch"
    expected = sorted(con.sql(f"SELECT {names} FROM ({quotes.ORACLE})").fetchall(), key=repr)
    assert sorted([tuple(r) for r in quotes.link_quotes(messages).select(*names.split(", ")).collect()], key=repr) == expected


def test_every_line_short_quotes_and_other_conversations(spark):
    rows = [
        (1, 0, "user", "The bridge over the river is closed today.\nTake the northern road instead."), (1, 1, "assistant", "yes, agreed"),
        (1, 2, "user", "> Hello again,\n> take the northern road instead.\nthanks"), (1, 3, "user", "> yes, agreed\nfine"), (1, 4, "user", "> no, never\nfine"),
        (2, 0, "user", "> A sentence that is said in two places.\nwhere from?"), (2, 1, "user", "A sentence that is said in two places."), (5, 3, "user", "A sentence that is said in two places."),
        (6, 0, "user", "> yes, agreed\nnot from elsewhere"), (7, 0, "user", "A sentence that is said in two places."), (4, 2, "user", "> A sentence that is said in two places."),
        (1, 3, "user", "the same key, nothing quoted"),
    ]
    found = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in found if r["clean_text"] != rows[-1][3]}
    assert len(found) == len(rows)
    assert got[1, 2] == (1, 0)  # its second line only
    assert got[1, 3] == (1, 1) and got[1, 4] == (None, None) and got[6, 0] == (None, None)  # short: in its own conversation only
    assert got[2, 0] == (7, 0) and got[4, 2] == (2, 1)  # its own conversation says it too late
    assert [r["n_linked"] for r in found if r["clean_text"] == rows[-1][3]] == [0]


def test_long_texts_empty_table_and_clashing_columns(spark):
    marks, many = ">" * 1_000_000 + " one line", "\n".join(f"> line {i} of very many" for i in range(300_000))
    rows = [(1, 0, "u", "line 299999 of very many"), (1, 1, "u", many), (1, 2, "u", marks), (1, 3, "u", " \t" * 200_000 + "> line 299999 of very many")]
    messages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", h int, source string")
    got = {r["turn"]: (r["max_level"], r["n_quoted"], r["n_linked"]) for r in quotes.link_quotes(messages).collect()}
    assert got == {0: (0, 0, 0), 1: (1, 1, 1), 2: (1_000_000, 1, 0), 3: (1, 1, 1)}
    assert quotes.link_quotes(messages.limit(0)).count() == 0
