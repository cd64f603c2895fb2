import random

from visagelake.llm import chat

A = "The lake is frozen today.\nWho wants to skate?"
B = "> The lake is frozen today.\n> Who wants to skate?\n\nI do, at noon."
C = "Paul wrote:\n>> The lake is frozen today.\n>> Who wants to skate?\n> I do, at noon.\nMe too, with my two sisters!"
D = "> who   wants to SKATE\nNot me."
ROWS = [(1, 0, "user", A), (1, 1, "user", B), (1, 2, "user", C), (1, 3, "user", D), (2, 0, "user", "> Me too, with my two sisters!\nAnd I."), (2, 1, "user", None), (3, 0, None, ""), (None, 0, "user", "> Me too, with my two sisters!"), (3, 1, "user", "> words of nobody\nText"), (3, 2, "x", "1 > 0 and no quote"), (4, 0, "u", "> only quote")]


def test_replies(spark):
    messages = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, depth string")
    out = chat.link(messages).collect()
    assert len(out) == len(ROWS)
    got = {(r.conv_id, r.turn): r for r in out}
    assert (got[1, 0].reply_turn, got[1, 1].reply_turn, got[1, 2].reply_turn, got[1, 3].reply_turn) == (None, 0, 1, 0)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn, got[2, 0].depth) == (1, 2, 3)
    assert [got[k].text for k in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (3, 2), (4, 0))] == [A, "I do, at noon.", "Me too, with my two sisters!", "Not me.", "And I.", "", "1 > 0 and no quote", ""]
    assert {k: got[k].thread_id for k in got} == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 0): 1, (2, 1): 2, (3, 0): 3, (3, 1): 3, (3, 2): 3, (4, 0): 4, (None, 0): None}
    assert got[None, 0].reply_conv is None and got[3, 1].reply_conv is None and got[3, 1].n_quotes == 1
    order = [(r.conv_id, r.turn) for r in chat.conversations(chat.link(messages)).collect() if r.conv_id]
    assert order[:6] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_deeper_levels_and_parts_of_paragraphs(spark):
    long = "We went down to the old harbour at dawn. The boats were already out, and only two men stood at the quay. Nobody spoke."
    rows = [
        (1, 0, "u", long), (1, 1, "u", "A reply with other words."), (1, 2, "u", "Third of them."),
        (1, 3, "u", ">> A reply with other words.\n\nTwo levels, the middle trimmed."),
        (1, 4, "u", "> some edited text\n>> A reply with other words.\n>>> Third of them.\nEdited."),
        (1, 5, "u", "> Third of them.\n>> A reply with other words. " + long + "\nFirst level first."),
        (1, 6, "u", "> Nobody spoke.\nOne sentence."),
        (1, 7, "u", "> already out, and only\n> two men stood at\nPart, wrapped anew."),
        (1, 8, "u", "> words that stand in no other message at all\nNothing."),
    ]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r.reply_turn for t, r in got.items()} == {0: None, 1: None, 2: None, 3: 1, 4: 1, 5: 2, 6: 0, 7: 0, 8: None}
    assert got[7].n_quotes == 3 and got[0].n_quotes == 0 and got[7].text == "Part, wrapped anew."


def brute(rows):
    own, out = [], {}
    for conv, turn, _, text in rows:
        own.append((conv, turn, {h for _, h, _ in chat.parse(text or "")[2]}))
    for conv, turn, _, text in rows:
        if conv is None:
            continue
        votes = {}
        for level, h, words in set(chat.parse(text or "")[1]):
            writers = sorted((c, t) for c, t, hs in own if c is not None and h in hs)
            mine = [w for w in writers if w[0] == conv][:1]
            far = writers and writers[0] < (conv, turn) and words >= chat.FAR_WORDS
            to = mine[0] if mine and mine[0][1] < turn else writers[0] if far else None
            weight = words if mine and to == mine[0] else words / max(len({c for c, _ in writers}), 1)
            if to:
                votes[level, to] = votes.get((level, to), 0) + weight
        best = max(votes, key=lambda k: (-k[0], round(votes[k], 6), k[1])) if votes else (0, (None, None))
        out[conv, turn] = best[1]
    return out


def test_long_chain_against_brute_force(spark):
    rows = [(9, 0, "u", "Start of all.")] + [(9, i, "u", f"> {'Start of all.' if i == 1 else f'Reply {i - 1}.'}\nReply {i}.") for i in range(1, 70)] + ROWS
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = brute(rows)
    assert all((r.reply_conv, r.reply_turn) == want[r.conv_id, r.turn] for r in got if r.conv_id is not None)
    assert max(r.depth for r in got) == 69


def test_short_and_common_passages_do_not_link_conversations(spark):
    rows = [("c1", "a", "u", "ok"), ("c1", "b", "u", "> ok\nFine."), ("c2", "a", "u", "> ok\nOther."), ("c3", "a", "u", "Thanks for all the help and have a nice day. The blue whale sings at night off the coast.")]
    rows += [(f"d{i}", "a", "u", "Hello. Thanks for all the help and have a nice day.") for i in range(30)]
    rows += [("z1", "a", "u", "> Thanks for all the help and have a nice day.\n> The ship with red sails came in at noon today.\nWell."), ("e", "a", "u", "The ship with red sails came in at noon today."), ("z2", "a", "u", "> a b\n" + "> word " * 3000)]
    got = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect()}
    assert got["c1", "b"].reply_turn == "a" and got["c2", "a"].reply_conv is None and got["c2", "a"].thread_id == "c2"
    assert got["z1", "a"].reply_conv == "e" and got["z1", "a"].thread_id == "e" and len(got) == len(rows)


def test_tables(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert sorted((r.conv_id, r.turn, r.text) for r in chat.link(messages).collect()) == sorted((r.conv_id, r.turn, r.text) for r in messages.collect())
    assert chat.conversations(chat.link(messages.limit(0))).collect() == []


def test_short_parts_of_lines_against_a_plain_search(spark):
    """Quotes of one line and two to five words; the search shares no code with the operator."""
    draw, rows, want = random.Random(3), [], {}
    names = [f"w{i}" for i in range(14)]
    for conv in range(25):
        said = []
        for turn in range(12):
            own = [draw.choice(names) for _ in range(draw.randint(2, 9))]
            quote = []
            if turn % 2:
                of = draw.choice(said)
                at = draw.randint(0, len(of) - 2)
                quote = of[at : at + draw.randint(2, 5)]
            whole = [t for t, x in enumerate(said) if x == quote and len(quote) < 5]
            within = [t for t, x in enumerate(said) if quote and any(x[i : i + len(quote)] == quote for i in range(len(x)))]
            want[conv, turn] = (whole or within or [None])[0]
            rows.append((conv, turn, "u", (f"> {' '.join(quote).upper()}\n" if quote else "") + " ".join(own)))
            said.append(own)
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.reply_turn for r in got} == want and all(r.reply_conv in (None, r.conv_id) for r in got)
    assert sum(t is not None for t in want.values()) == 25 * 6


def test_short_parts_do_not_leave_their_conversation(spark):
    rows = [(1, 0, "u", "The train leaves the old station at six."), (1, 1, "u", "> The train leaves the\nWhich one?"), (2, 0, "u", "> train leaves the\nElsewhere."), (1, 2, "u", "> station\nOne word of a line."), (1, 3, "u", "> leaves later\nNobody said so."), (1, 4, "u", "leaves later, then")]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (None, None), (1, 1): (1, 0), (2, 0): (None, None), (1, 2): (None, None), (1, 3): (None, None), (1, 4): (None, None)}


def test_order_of_conversations_from_a_column(spark):
    line = "Seven grey geese crossed the river before the storm."
    rows = [("9", 0, "u", line, 1), ("10", 0, "u", f"> {line}\nI saw them too.", 2), ("8", 0, "u", f"> {line}\nEarlier than all.", 0), ("7", 0, "u", f"> {line}\nNo time known.", None)]
    messages = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, at long")
    by_time = {r.conv_id: r.reply_conv for r in chat.link(messages, "at").collect()}
    assert by_time == {"9": None, "10": "9", "8": None, "7": None}
    by_id = {r.conv_id: r.reply_conv for r in chat.link(messages).collect()}
    assert by_id == {"9": None, "10": None, "8": None, "7": None}
