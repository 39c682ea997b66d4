"""Chat parts by place: against SQL, and joined again to the whole view."""

from __future__ import annotations

from collections import defaultdict

from candlewick.llm import chat

ROWS = [
    *[(1, t, "system" if t in (0, 100) else f"p{t % 3}", f"w{t}") for t in range(200)],  # long, with system turns in two parts
    *[(2, None, "a" if i % 2 else "b", f"x{i % 5}") for i in range(150)],  # turns without a number, many alike
    *[(3, 7, None, None) for _ in range(130)],  # one number for all
    (4, 0, "system", "only"), (None, 0, "a", "x"), (None, 1, "b", "y"), (5, 0, "system", "s"), (5, 1, "a", "é"),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_parts_join_to_the_whole_view(spark):
    got = chat.rotate_whole(spark.createDataFrame(ROWS, SCHEMA)).collect()
    views = defaultdict(list)
    for r in got:
        views[r.conv_id, r.participant].append(r)
    want = {(c, r or "unknown") for c, _, r, _ in ROWS if r != "system"}
    assert set(views) == want
    for (conv, view), parts in views.items():
        parts.sort(key=lambda r: r.part)
        turns = sorted((-1 if t is None else t, r or "unknown", x or "") for c, t, r, x in ROWS if c == conv)
        named = lambda r: "assistant" if r == view else "system" if r == "system" else f"user name={r}"  # noqa: B023, E731
        one = [f"{chat.START}{named(r)}\n{x}{chat.END}" for _, r, x in turns]
        assert "".join(p.text[p.carried :] for p in parts) == "".join(one)
        assert [p.part for p in parts] == list(range(parts[0].n_parts)) and {p.n_parts for p in parts} == {-(-len(turns) // 64)}
        for p in parts:
            assert p.first_turn == 64 * p.part and p.n_turns == min(64, len(turns) - p.first_turn)
            assert p.text[: p.carried] == "".join(x for x, t in zip(one[: p.first_turn], turns) if t[1] == "system")
            assert [p.text[m.start : m.end] for m in p["mask"]] == [x for _, r, x in turns[p.first_turn : p.first_turn + 64] if r == view]
    assert chat.rotate_whole(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_equals_sql(spark, duck, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.query_whole(spark, str(tmp_path))
    columns = sorted(got.columns)
    duck.execute(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    try:
        assert sorted(duck.sql(chat.SQL_WHOLE).columns) == columns
        want = duck.sql(f"SELECT {', '.join(columns)} FROM ({chat.SQL_WHOLE})").fetchall()
    finally:
        duck.execute("DROP VIEW temp.conversations")
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
