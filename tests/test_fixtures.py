"""The table of lines: its rows on a small conversation, and no row per line before it is timed."""

from cueline.plans import fixtures


def test_lines_are_placed_by_turn(spark, tmp_path, monkeypatch):
    turns = [(7, t, "user" if t % 2 else "assistant", text) for t, text in enumerate(["a bé, c\n\ndd", "", "\n", None, "eee f.", "g"])]
    turns += [(-3, t, "user", "xx. yy" * (t % 3)) for t in range(130)]  # three blocks of turns, a negative id
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plans, write = {}, fixtures.materialise

    def spied(df, name, *rest):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *rest)

    monkeypatch.setattr(fixtures, "materialise", spied)
    rest = lambda a, n: abs(a) % n * (1 if a >= 0 else -1)
    for make, marks, clean in ((fixtures.segments, (250, 500), lambda t: t.split("\n")), (fixtures.open_segments, (25, 50), lambda t: t.translate({44: None, 46: None}).replace("\n", " ").split(" "))):
        want = []
        for key in (7, -3):
            line, at = 0, 0
            for conv, _, role, text in turns:
                for word in clean(text or "") if conv == key else ():
                    if word:
                        shown, gap = len(word) * (40 + 10 * rest(key + line, 4)), rest(key * 31 + line * 17, 11) * marks[0] - marks[1]
                        want.append((key, line, role, word, at, at + shown))
                        line, at = line + 1, at + shown + gap
        got = make(spark, str(tmp_path)).collect()
        assert sorted((r.transcript_id, r.seg_idx, r.speaker, r.text, r.start_ms, r.end_ms) for r in got) == sorted(want)
        order = sorted(got, key=lambda r: (r.transcript_id, r.start_ms, r.seg_idx))
        assert [r.pos for r in order] == [*range(sum(r.transcript_id == -3 for r in got)), *range(sum(r.transcript_id == 7 for r in got))]
        assert "Generate" not in plans["turn-blocks"] and "Generate" not in plans["timed-lines"]
