"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.sources import code_items
from weftline.streaming.metrics import limit_rows


@given(st.text(alphabet="{}\"';a \n", max_size=80))
def test_blocks_are_balanced(code):
    end = code_items.block(code, 0)
    if end > 0:
        assert code[end - 1] == "}" and code[:end].count("{") >= 1


@given(st.text(alphabet="ab().x \n", max_size=60), st.integers(0, 15))
def test_longer_gaps_never_shorten_a_run(text, gap):
    assert code_items.longest_run(code_items.ACCESS, text, gap) <= code_items.longest_run(code_items.ACCESS, text, gap + 5)


@given(st.text(max_size=200), st.sampled_from(["python", "java", "go", "rust", "cpp", "csharp", "kotlin", "php", "typescript", "ruby", "what", None]))
@settings(max_examples=60)
def test_extraction_never_fails(code, language):
    for item in code_items.extract(code, language):
        assert item["loc"] >= 0 and item["line"] >= 1


class State:
    def __init__(self):
        self.value, self.exists, self.hasTimedOut = None, False, False

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value, self.exists = v, True

    def remove(self):
        self.exists = False

    def setTimeoutDuration(self, _):
        pass


@given(st.lists(st.integers(0, 600), min_size=1, max_size=120), st.integers(1, 100))
@settings(max_examples=40)
def test_bucket_never_grants_more_than_it_may(seconds, capacity):
    import pandas as pd

    pdf = pd.DataFrame({"ts": pd.to_datetime(sorted(seconds), unit="s"), "event_id": range(len(seconds))})
    out = next(limit_rows(capacity, None)(("c",), iter([pdf]), State()))
    span = max(seconds) - min(seconds)
    assert out["allowed"].sum() <= capacity + span * capacity / 60 + 1e-6
    assert bool(out["allowed"].iloc[0])
