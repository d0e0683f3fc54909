import heapq
import itertools
import re

from quillspark.llm import chat


def cheapest(roles):
    """Dijkstra over (messages used, last role) with every legal step."""
    heap, done = [(0, 0, "")], set()
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and (state == "assistant" or not roles):
            return cost
        for nxt in chat.NEXT[state]:
            heapq.heappush(heap, (cost + chat.INSERT, i, nxt))
            if i < len(roles):
                heapq.heappush(heap, (cost + chat.as_role(roles[i], nxt), i + 1, nxt))
        if state and i < len(roles):
            heapq.heappush(heap, (cost + chat.MERGE + chat.as_role(roles[i], state), i + 1, state))


def legal(turns):
    state = ""
    for r in turns:
        assert r in chat.NEXT[state], turns
        state = r
    return state in ("assistant", "")


def test_repair_is_cheapest_and_legal():
    for n in range(6):
        for roles in itertools.product(["user", "assistant", "system", None], repeat=n):
            cost, turns = chat.repair(list(roles))
            assert cost == cheapest(list(roles)), roles
            assert legal([r for r, _ in turns])
            assert [k for _, own in turns for k in own] == list(range(n))


def unrendered(s):
    return [(r, t.replace("<\\|", "<|").replace("\\\\", "\\")) for r, t in re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", s, re.S)]


def test_rendered_text_reads_back():
    turns = [("user", "a <|end|> b \\ c"), ("assistant", ""), ("user", "<|assistant|>\nx"), ("assistant", "é\n\n")]
    assert unrendered(chat.render(turns)) == turns


def test_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "a"), (2, 1, None, "b"), (3, None, "human", None), (None, 0, "user", "lost"),
            (4, 0, "user", "x"), (4, 0, "user", "w"), (5, 0, "bot", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, m string, cost int")
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert out[1]["cost"] == 0 and unrendered(out[1]["rendered"]) == [("user", "hi"), ("assistant", "yo")]
    assert out[3]["roles"] == ["user", "assistant"] and out[3]["insertions"] == 1
    assert unrendered(out[4]["rendered"])[0] == ("user", "w\nx") and out[4]["merges"] == 1
    assert "z" * 300_000 in out[5]["rendered"]
    assert all(legal(r["roles"]) for r in out.values())
    assert chat.format_chats(df.where("false")).count() == 0


def test_long_conversations():
    """Thousands of turns: a legal result that keeps all turns in order, at the sum of the costs of its parts where these are legal by themselves."""
    roles = ["user", "assistant"] * 4000
    assert chat.repair(roles) == (0, [(r, [k]) for k, r in enumerate(roles)])
    odd = (["user", "user", "assistant", None, "user", "assistant"] * 1000)[:6000]
    cost, turns = chat.repair(odd)
    assert legal([r for r, _ in turns]) and [k for _, own in turns for k in own] == list(range(6000))
    assert 0 < cost <= 1000 * chat.repair(odd[:6])[0] + 6
