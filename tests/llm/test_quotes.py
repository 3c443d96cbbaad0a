import random

from strandline.llm import quotes as Q

FIRST = "Hello, could you explain joins?\n\nAlso tell me about windows please."
ROWS = [
    (1, 0, "user", FIRST),
    (1, 1, "assistant", "A join matches rows of two tables."),
    (1, 2, "user", "On Monday A wrote:\n> A join matches rows\n> of two tables.\nThanks, and outer ones?"),
    (1, 3, "assistant", "> Thanks, and outer ones?\n>> A join matches rows of two tables.\nThey keep rows too."),
    (2, 0, "user", "> They keep rows  too.\nIs that really so?"),
    (2, 1, "user", "> also tell me about WINDOWS please.\nYes, that as well."),
    (2, 2, "user", "> ok\nA short quote links nothing."),
    (None, 0, "x", "> They keep rows too."),
    (3, None, None, "A join matches rows of two tables."),
    (3, 1, None, None),
    (4, 0, "user", ""),
]


def test_links_and_order(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, parent string")
    got = {(r.conv_id, r.turn): r for r in Q.linked_messages(df).collect()}
    assert len(got) == len(ROWS)
    parent = {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.reply_conv is not None}
    assert parent == {(1, 2): (1, 1), (1, 3): (1, 2), (2, 0): (1, 3), (2, 1): (1, 0)}
    assert got[1, 2].text == "Thanks, and outer ones?" and got[1, 3].max_level == 2 and got[1, 3].n_linked == 2
    assert got[2, 2].n_quotes == 1 and got[2, 2].n_linked == 0
    assert (got[2, 0].thread_conv, got[2, 0].root_turn, got[2, 0].depth) == (1, 1, 3)
    assert got[None, 0].text == "" and got[3, 1].text is None and got[1, 0].text == FIRST
    order = sorted((k for k in got if None not in k), key=lambda k: (got[k].thread_conv, got[k].root_turn, got[k].depth, *k))
    assert all(order.index(p) < order.index(k) for k, p in parent.items())
    assert Q.linked_messages(df.limit(0)).count() == 0


def test_a_phrase_that_all_say(spark):
    rows = [(i, t, "user", "> Good morning everybody!\nGood morning everybody!") for i in range(40) for t in range(3)]
    df = spark.createDataFrame(rows + rows[:5], "conv_id long, turn long, role string, text string")
    got = Q.linked_messages(df).collect()
    assert len(got) == 125
    assert all((r.reply_conv, r.reply_turn) == ((r.conv_id, 0) if r.turn else (0, 0)) for r in got if (r.conv_id, r.turn) != (0, 0))


def test_levels():
    assert list(Q.levels("a\n> b\n> > c\n>>d\n e")) == [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (0, " e")]
    assert Q.parsed("x " * 50000)[1] == []


def test_no_rings_across_conversations(spark):
    rows = [(1, 0, "u", "> the second said it first\nthe first said it first"), (2, 0, "u", "> the first said it first\nthe second said it first")]
    rows += [(3, i, "u", f"> sentence number {i - 1}\nsentence number {i}") for i in range(20)]
    got = {(r.conv_id, r.turn): r for r in Q.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0].reply_conv, got[2, 0].reply_conv) == (None, 1)
    assert [got[3, i].depth for i in range(20)] == list(range(20)) and got[3, 19].root_turn == 0


def rows_of(spark, rows):
    return {(r.conv_id, r.turn): r for r in Q.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}


def test_an_original_in_a_later_conversation(spark):
    said = "what was said at length"
    # the first to say it in 4 is too late for (4, 0); 9 says it too
    rows = [(1, 0, "u", f"> {said}\nI see."), (2, 3, "u", said), (4, 0, "u", "> another long sentence\nOh."), (4, 1, "u", "another long sentence"), (9, 0, "u", "another long sentence")]
    got = rows_of(spark, rows)
    parent = {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.reply_conv is not None}
    assert parent == {(1, 0): (2, 3), (4, 0): (9, 0)}
    assert (got[1, 0].thread_conv, got[1, 0].root_turn, got[1, 0].depth, got[1, 0].n_linked) == (2, 3, 1, 1)


def test_a_short_message_is_quoted_whole(spark):
    rows = [(1, 0, "u", "Yes, I agree"), (1, 1, "u", "> Yes, I agree\nGood."), (1, 2, "u", "> good.\n> Yes, I agree\nBoth."), (2, 0, "u", "> Yes, I agree\nNot said here."), (2, 1, "u", ">\n\nhm"), (2, 2, "u", "> \nhm")]
    got = rows_of(spark, rows)
    assert {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.n_linked} == {(1, 1): (1, 0)}


def test_rings_of_any_length_lose_one_link(spark):
    say = lambda i: f"sentence number {i} of the ring"
    for n in (2, 3, 4, 7, 8):
        order = [(i * 3) % n if n % 3 else i for i in range(n)]
        rows = [(order[i], 0, "u", f"> {say(order[(i + 1) % n])}\n{say(order[i])}") for i in range(n)]
        # a chain that leads into the ring, and one apart from it
        rows += [(100 + i, 0, "u", f"> {say(100 + i - 1 if i else 0)}\n{say(100 + i)}") for i in range(5)]
        rows += [(200 + i, 0, "u", f"> {say(200 + i + 1)}\n{say(200 + i)}") for i in range(6)]
        got = rows_of(spark, rows)
        assert [k for k, r in got.items() if r.reply_conv is None and k[0] < 200] == [(0, 0)]
        assert got[0, 0].n_linked == 1 and got[0, 0].depth == 0 and got[0, 0].thread_conv == 0
        assert [got[100 + i, 0].depth for i in range(5)] == [1, 2, 3, 4, 5] and got[104, 0].thread_conv == 0
        assert [got[200 + i, 0].depth for i in range(6)] == [5, 4, 3, 2, 1, 0]
        assert sorted(got[i, 0].depth for i in range(n)) == list(range(n))


def texts_of(text, whole, paragraphs, lines):
    """What of a text links, longest kinds first: (normal text, only within its conversation)."""
    out = []
    for i, part in enumerate([whole, *paragraphs, *lines]):
        part = Q.normal(part)
        short = sum(c.isalnum() for c in part) < Q.LEAST
        if part and (i == 0 or not short) and (part, short) not in out:
            out.append((part, short))
    return out


def split(text):
    """Own words and passages of a message, as lists of lines."""
    own, passages, last = [], [], 0
    for level, line in Q.levels(text):
        if not level:
            own.append(line)
        elif level != last:
            passages.append((level, [line]))
        else:
            passages[-1][1].append(line)
        last = level
    return own, passages


def nested_loops(rows):
    """Every passage compared with every message; links as passage_links gives them."""
    said = {}
    for c, t, _, text in rows:
        own, passages = split(text)
        whole = "\n".join(own).strip("\n") if passages else text or ""
        said[c, t] = texts_of(text, whole, Q._BLANK.split(whole), own)
    links = {}
    for c, t, _, text in rows:
        for p, (level, lines) in enumerate(split(text)[1]):
            whole = "\n".join(lines)
            by_length = lambda parts: sorted(parts, key=len, reverse=True)
            candidates = []
            for place, unit in enumerate(texts_of(text, whole, by_length(Q._BLANK.split(whole)), by_length(lines))):
                inside = min((t2 for (c2, t2), units in said.items() if c2 == c and t2 < t and unit in units), default=None)
                outside = min(((c2, t2) for (c2, t2), units in said.items() if c2 != c and unit in units), default=None)
                if inside is not None:
                    candidates.append((False, place, (c, inside)))
                elif outside is not None and not unit[1]:
                    candidates.append((True, place, outside))
            if candidates:
                links[c, t, p, level] = min(candidates)
    return links


def random_threads(seed, n=60):
    """Conversations whose messages quote others: whole, a paragraph, a line, or
    wrapped anew; with phrases that many share.  Returns rows and what was quoted."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    paragraph = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 3)))
    rows, planted, own = [], {}, {}
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            body = "\n\n".join(paragraph() for _ in range(rng.randint(1, 3)))
            if rng.random() < 0.2:
                body += "\n\nThank you very much in advance!"
            text = body
            if own and rng.random() < 0.7:
                near = [k for k in own if k[0] == c]
                k = rng.choice(near if near and rng.random() < 0.8 else list(own))
                kind = rng.choice(["whole", "paragraph", "line", "wrapped"])
                part = own[k]
                if kind == "paragraph":
                    part = rng.choice(part.split("\n\n"))
                elif kind == "line":
                    part = rng.choice([x for x in part.split("\n") if x])
                elif kind == "wrapped":
                    flat = [p.split() for p in part.split("\n\n")]
                    part = "\n\n".join("\n".join(" ".join(p[i : i + 4]) for i in range(0, len(p), 4)) for p in flat)
                mark = rng.choice(["> ", ">", "> > "])
                text = "\n".join(mark + x for x in part.split("\n")) + "\n" + body
                planted[c, t] = k
            own[c, t] = body
            rows.append((c, t, "user", text))
    return rows, planted


def test_links_are_those_of_nested_loops(spark):
    found = right = 0
    for seed in (1, 2):
        rows, planted = random_threads(seed)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {(r.conv_id, r.turn, r.passage, r.level): (r.to_conv, r.to_turn) for r in Q.passage_links(df).collect()}
        want = nested_loops(rows)
        assert got == {k: to for k, (_, _, to) in want.items()}
        messages = {(r.conv_id, r.turn): r for r in Q.linked_messages(df).collect()}
        for k, r in messages.items():
            assert r.n_linked == sum(x[:2] == k for x in want)
            own = [(level, far, place, p, to) for (c, t, p, level), (far, place, to) in want.items() if (c, t) == k]
            if own and r.reply_conv is not None:
                assert (r.reply_conv, r.reply_turn) == min(own)[-1]
        # of the planted quotes, how many replies lead to the message that was quoted
        for k, to in planted.items():
            found += 1
            right += (messages[k].reply_conv, messages[k].reply_turn) == to
    assert found > 100 and right >= 0.9 * found


def test_places(spark, monkeypatch):
    """Gapless in every thread, replies after originals, also in a thread that has most messages."""
    monkeypatch.setattr("strandline.llm.common.HOT_KEYS", 4)
    rows, _ = random_threads(3, 30)
    said = "this is what all of them answer to"
    rows += [(1000, 0, "u", said)] + [(1000, i, "u", f"> {said}\nanswer number {i} of many") for i in range(1, 300)]
    rows += [(None, 1, "u", "x"), (1000, None, "u", "y")] + rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Q.linked_messages(df).collect()
    assert len(got) == len(rows) and sum(r.place is None for r in got) == 2
    threads = {}
    for r in got:
        if r.place is not None:
            threads.setdefault((r.thread_conv, r.root_turn), set()).add(r)
    assert max(map(len, threads.values())) == 300
    for members in threads.values():
        assert sorted(r.place for r in members) == list(range(len(members)))
        order = sorted(members, key=lambda r: r.place)
        assert [(r.depth, r.conv_id, r.turn) for r in order] == sorted((r.depth, r.conv_id, r.turn) for r in order)
    at = {(r.conv_id, r.turn): r.place for r in got}
    assert all(at[r.reply_conv, r.reply_turn] < r.place for r in got if r.reply_conv is not None)
