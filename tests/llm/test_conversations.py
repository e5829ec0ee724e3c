"""Grammar-compressed repair against trying every edit sequence, and its oracle."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from chainloom.llm import conversations, queries
from compare import check, connect

LEGAL = re.compile("(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string, pos int, audit string"


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "." if last[0] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, repaired rows) by a plain walk over rows and roles so far, strings and all."""
    best = {"": (0, "", ())}  # by the roles' initials, shortened to the state

    def state(roles):
        return roles if len(roles) < 2 else roles[-1]

    def put(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def grown(found):
        out = dict(found)
        for _ in range(3):
            for key, (c, a, rs) in list(out.items()):
                for role in ("user", "assistant"):
                    if follows(key, role[0]):
                        put(out, state(key + role[0]), (c + 5, a + "I", rs + (role + ":",)))
        return out

    def follows(key, initial):
        return (key, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    best = {"": (0, "", ())}
    for (_, role, text), f in zip(rows, bad):
        new = {}
        for key, (c, a, rs) in grown(best).items():
            put(new, key, (c + 2, a + "D", rs))
            if f in "bd":
                continue
            more = 5 if f == "t" else 0
            if follows(key, role[:1]):
                put(new, role[:1], (c + more, a + "K", rs + (f"{role}:{text}",)))
            for r in ("user", "assistant"):
                if follows(key, r[0]):
                    put(new, r[0], (c + more + 1, a + "R", rs + (f"{r}:{text}",)))
        best = new
    return min(v for k, v in grown(best).items() if k in ("", "a"))


def plain(rows):
    rows = ordered(rows)
    bad = faults(rows)
    cost, audit, made = cheapest(rows, bad)
    assert LEGAL.fullmatch("".join(m[0] for m in made))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("b"), bad.count("d"), bad.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest())


def some(rng, n, texts):
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    return [(rng.choice([i, i, i, None]) if rng.random() < 0.1 else i, rng.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for i in range(n)]


def frame(spark, convs):
    return spark.createDataFrame([(c, t, r, x, 1, "clash") for c, rows in convs.items() for t, r, x in rows], TURNS).repartition(4)


def table(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def conversations_of_all_kinds():
    rng = random.Random(2)
    texts = [f"text {i}{e}" for i in range(40) for e in (".", "?", " ", "...")] + ["", " \n", None, "é\n", "long " * 9000 + "."]
    convs = {i: some(rng, rng.randrange(1, 12), texts) for i in range(120)}
    convs |= {200 + i: convs[5] for i in range(30)}  # copies
    convs[None] = [(0, "user", "Hi."), (1, "assistant", "Yes.")]
    convs[300] = [(None, "user", "a."), (None, "assistant", "b.")]
    convs[301] = [(5, None, None)]
    convs[302] = [(-(1 << 63), "user", "a."), ((1 << 63) - 1, "assistant", "b.")]
    convs[303] = [(i, "user", "same.") for i in range(50)]
    return convs


def test_repair_equals_plain_search(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 7)  # nearly every conversation in several blocks
    convs = conversations_of_all_kinds()
    convs[400] = some(random.Random(4), 700, [f"t{i}{e}" for i in range(300) for e in ".!x"])
    want = {c: plain(rows) for c, rows in convs.items()}
    want[302] = ((1 << 63) - 1, *want[302][1:])  # saturated
    turns = frame(spark, convs)
    assert table(conversations.repair_digest(turns, turns)) == want
    edits = sorted(conversations.repaired(turns).collect(), key=lambda r: (r.conv_id or -1, r.pos, r.step))
    for c, (*_, audit, sha) in want.items():
        mine = [r for r in edits if r.conv_id == c]
        assert "".join(r.edit for r in mine) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == sha


def test_whole_blocks_and_no_grammar_give_the_same(spark, monkeypatch):
    convs = conversations_of_all_kinds()
    turns = frame(spark, convs)
    whole = table(conversations.repair_digest(turns))
    monkeypatch.setattr(conversations.grammar, "__defaults__", (0, 1))
    assert table(conversations.repair_digest(turns)) == whole


def test_damage_and_conversations_without_rows(spark):
    convs = {i: [(t, ["user", "assistant"][t % 2], f"Line {t}. Next! {i}?") for t in range(2)] for i in range(150)}
    convs[None] = [(0, "user", None), (None, None, "x.")]
    turns = frame(spark, convs)
    want = {}
    for c, rows in convs.items():
        kept = []
        for t, r, x in rows:
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if d == 1 else re.sub("[.!?]", "", x or " ") if d == 2 else x
            kept += [] if d == 0 else [(t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
        want[c] = plain(kept)
    assert table(conversations.repair_digest(conversations.damaged(turns), turns)) == want
    none = turns.limit(0)
    assert table(conversations.repair_digest(none, turns)) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in convs}
    assert conversations.repaired(none).count() == 0


@pytest.mark.parametrize("symbols", ["uauaua", "sUAoxu", "xxxx", "aaaa", "uuAAss", "ooSx"])
def test_ropes_read_as_their_letters(symbols):
    rules = conversations.Grammar([[("ua", "\ue000")], [("\ue000\ue000", "\ue001")]])
    m = rules.known(symbols)
    roles = {"s": "s.", "u": "user", "a": "assistant", "o": "o"}
    rows = [(i, roles.get(c.lower(), "user"), f"{i}") for i, c in enumerate(symbols)]
    bad = ["b" if c == "x" else "t" if c.isupper() else "." for c in symbols]
    cost, audit, _ = cheapest(rows, bad)
    solved = conversations._solve(rules, [(0, 0, symbols, "")])
    assert (solved[0][5], solved[0][3]) == (cost, audit)


def test_repair_oracle(spark):
    sf = "/root/testdata/sf0.01"
    _, n, problem = check(spark, connect(sf), sf, "op11", queries.QUERIES["op11_grammar_repair"], queries.ORACLE["op11_grammar_repair"])
    assert not problem and n
