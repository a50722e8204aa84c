import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import textkit as tk


def test_words_and_windows_against_python(texts):
    column = pa.array(texts)
    rows, by_word, by_window = 0, {}, {}
    for limit in (64, 1 << 18):
        rows = 0
        for lo, hi, buf, off in tk.text_slices(column, limit):
            w = tk.Words(buf, off)
            h = w.hashes()
            for lane in (0, 1):
                for k in (1, 5, 35):
                    win, ok = tk.windows(h, k, lane), w.valid(k)
                    for i in range(hi - lo):
                        mine = re.findall(rb"[^\x20\x09-\x0D]+", (texts[lo + i] or "").encode())[:500]
                        a = w.woff[i]
                        assert w.count[i] >= len(mine)
                        assert int(ok[a : w.woff[i + 1]].sum()) == max(0, w.count[i] - k + 1)
                        for j in range(0, len(mine) - k + 1, 7):
                            key = (lane, k, b" ".join(mine[j : j + k]))
                            assert by_window.setdefault(key, win[a + j]) == win[a + j]
            rows += hi - lo
        assert rows == len(texts)
    assert len(set(by_window.values())) == len(by_window)


def test_covered_marks_whole_windows():
    rng = random.Random(1)
    for _ in range(50):
        n, k = rng.randrange(1, 40), rng.randrange(1, 6)
        hit = np.array([rng.random() < 0.2 and i + k <= n for i in range(n)])
        want = [any(hit[j] for j in range(max(0, i - k + 1), i + 1)) for i in range(n)]
        assert tk.covered(hit, k).tolist() == want
        assert tk.unbits(tk.bits(hit), n).tolist() == hit.tolist()


@pytest.mark.parametrize("column", [pa.array([], pa.string()), pa.array([None, None], pa.string()), pa.array(["", None, "a"]).slice(1), pa.array(["x y"], pa.large_string())])
def test_slices_of_odd_columns(column):
    assert sum(hi - lo for lo, hi, _, _ in tk.text_slices(column)) == len(column)
    for _, _, buf, off in tk.text_slices(column):
        w = tk.Words(buf, off)
        assert len(w.hashes()) == len(w.start) == len(w.valid(5)) == w.count.sum()
