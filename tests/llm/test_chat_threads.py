"""Quotation linking against a plain version on generated conversations, and edge cases."""

import random

from framegrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(n_conv=60, n_turns=40, seed=2):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for c in range(n_conv):
        said = []
        for t in range(n_turns):
            own = [" ".join(r.choices(words, k=r.randint(4, 9))).capitalize() + "." for _ in range(r.randint(1, 4))]
            head = []
            if said and r.random() < 0.7:
                for depth in range(1, r.randint(1, 3) + 1):
                    if r.random() < 0.8:
                        source = r.choice(said)
                        lines = source if r.random() < 0.4 else [r.choice(source)]
                    else:
                        lines = ["A passage of a book number " + str(r.random())]
                    head += [r.choice((">", "> ")) * depth + x for x in lines]
            said.append(own)
            rows.append((c, t, r.choice(("user", "assistant")), "\n".join([*head, *own])))
    return rows


def plain_links(rows):
    """(reply_to, n_matched, text) by conversation and turn, by looking through all earlier turns of every piece."""
    out, said = {}, {}
    for c, t, _, text in rows:
        own, passages = chat.parse_quotes(text)
        pieces = {(chat.normal(x), d) for d, p in passages for x in [p, *p.split("\n\n"), *p.split("\n")] if chat.normal(x)}
        votes, hits = {}, {}
        for x, d in pieces:
            origin = max((u for u in range(t) if x in said[c, u]), default=None)
            if origin is not None:
                votes[origin] = votes.get(origin, 0) + (len(x) if d == 1 else 0)
                hits.setdefault(origin, set()).add(x)
        said[c, t] = {chat.normal(x) for x in [own, *own.split("\n\n"), *own.split("\n")]}
        found = set().union(*hits.values()) if hits else set()
        reply = max(votes, key=lambda u: (votes[u], u)) if votes else (t - 1 if t else None)
        kept = []
        whole = {i: p for i, (d, p) in enumerate(passages)}
        at, last = -1, 0
        for d, bare, line in chat.quoted_lines(text):
            at += bool(d and d != last)
            last = d
            if not d or (chat.normal(bare) not in found and chat.normal(whole[at]) not in found):
                kept.append(line)
        out[c, t] = (reply, sum(map(len, hits.values())), "\n".join(kept))
    return out


def test_links_threads_and_positions(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r.conv_id, r.turn): r for r in chat.reply_threads(chat.link_quotes(df)).collect()}
    want = plain_links(rows)
    assert {k: (r.reply_to, r.n_matched, r.text) for k, r in got.items()} == want
    assert sum(n for _, n, _ in want.values()) > 1000 and any("book" in x for _, _, x in want.values())
    assert sum(reply != t - 1 for (_, t), (reply, _, _) in want.items() if t) > 500
    threads = {}
    for (c, t), r in sorted(got.items()):
        up = want[c, t][0]
        assert (r.thread, r.level) == ((t, 0) if up is None else (got[c, up].thread, got[c, up].level + 1))
        threads.setdefault((c, r.thread), []).append(r.position)
    assert all(p == list(range(len(p))) for p in threads.values())


def test_positions_go_on_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = conversations(3, 50, seed=4)
    got = {(r.conv_id, r.turn): r for r in chat.reply_threads(chat.link_quotes(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {k: (r.reply_to, r.n_matched, r.text) for k, r in got.items()} == plain_links(rows)
    for c in range(3):
        assert [got[c, t].position for t in range(50) if got[c, t].thread == 0] == list(range(sum(r.thread == 0 for k, r in got.items() if k[0] == c)))


def test_only_quotes_that_were_found_go():
    said = {chat.hash_of(x) for x in ("The red house.", "One.\nTwo.")}
    assert chat.without("> The red house.\nBehind it.", said) == "Behind it."
    assert chat.without("> A book says this.\nMy view.", said) == "> A book says this.\nMy view."
    assert chat.without("> The red house.\n> A book says this.\n\nMy view.", said) == "> A book says this.\n\nMy view."
    assert chat.without("> One.\n> Two.\n>\n> The red house.\n>\nMine.", said) == "Mine."
    assert chat.without("> One.\n> Two.\n>\n> A book.\nMine.", said) == ">\n> A book.\nMine."
    assert chat.without(">\n> ???\nMine.", said) == ">\n> ???\nMine." and chat.without("", said) == ""


def test_edges(spark):
    rows = [(1, 0, "user", "Hello there."), (1, 1, None, None), (1, 1, None, None), (None, 0, "user", "Hello there."), (None, 1, "user", "> Hello there.\nYes."), (1, None, "user", "> Hello there.\nNo turn."), (1, 2, "user", ">" * 5000 + " x"), (1, 3, "user", "> y\n" * 20000 + "end"), (2, 7, "", "")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", level int, thread string").repartition(3)
    out = chat.reply_threads(chat.link_quotes(df))
    got = [r for r in out.collect()]
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[None, 1].reply_to == 0 and by[None, 1].text == "Yes." and by[None, 1].position == 1
    assert by[1, None].reply_to is None and by[1, None].thread is None and by[1, None].position is None and by[1, None].text.startswith("> Hello")
    assert by[1, 1].text == "" and by[1, 1].formatted.startswith("<|unknown|>") and [r.position for r in got if r.turn == 1 and r.conv_id == 1] == [1, 1]
    assert by[1, 3].text.endswith("end") and by[1, 3].n_matched == 0 and by[2, 7].level == 0
    assert chat.reply_threads(chat.link_quotes(df.limit(0))).count() == 0
