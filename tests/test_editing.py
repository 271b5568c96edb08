from logweir.lang import editing as e
from logweir.lang.errors import Location
from logweir.streaming.metrics import Metrics


def test_clauses():
    assert e.clause("a b", "!=", 'x"y') == '"a b"!="x\\"y"' and e.quote("and") == '"and"' and e.quote("a/b:c") == "a/b:c"
    text = e.add_clause("", "a", "=", "1")
    text = e.add_clause(text, "b", "!=", "two words")
    assert text == 'a=1 AND b!="two words"' == e.add_clause(text, "a", "=", "1")
    assert e.clauses(text) == [("a", "=", "1"), ("b", "!=", "two words")]
    assert e.remove_clause(text, "a", "=", "1") == 'b!="two words"' and e.remove_clause(text, "c", "=", "1") == text
    assert e.remove_clause("a=1 OR ((b=2)) AND c=3", "b", "=", "2") == "a=1 AND c=3"
    assert e.remove_clause("(a=1) OR c=3", "a", "=", "1") == "c=3" and e.clauses("a='") == []


def test_small_helpers():
    assert e.balanced("{a=1} (b='(')") and not e.balanced("(a=1") and not e.balanced("(a=1]") and not e.balanced("a='x")
    text, moved = e.with_range("-5m", "now", "x")
    assert text == "[-5m,now] x" and e.shifted((Location(1, moved + 1, "m"), Location(2, 3, "n")), moved) == [Location(1, 1, "m"), Location(2, 3, "n")]
    assert e.remember(["b", "a"], "a") == ["a", "b"] and len(e.remember([str(i) for i in range(10)], "x")) == 10
    assert e.completions(["Level", "line", "x", "l1", "l2", "l3", "l4"], "l") == ["Level", "l1", "l2", "l3", "l4"]


def test_metrics():
    m = Metrics()
    m.add("requests", path="/q")
    m.observe("ms", 60)
    text = m.exposition()
    assert 'requests{path="/q"} 1' in text and 'ms_bucket{le="50"} 0' in text and 'ms_bucket{le="100"} 1' in text and "ms_count 1" in text
