import datetime as dt
import random

from casefile.llm.url_filter import judge_urls

DAY = dt.datetime(2024, 1, 1)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "x.other.org", "localhost"]
    entries = [(rng.choice(hosts).upper() if i % 9 == 0 else rng.choice(hosts), rng.choice(["block", "allow", "remove"]), DAY + dt.timedelta(days=rng.randint(0, 400))) for i in range(120)]
    captures = [(i, f"https://u@{rng.choice(hosts)}:80/p?q#f", DAY + dt.timedelta(days=rng.randint(0, 400), hours=rng.choice([0, 5]))) for i in range(300)]
    out = judge_urls(spark.createDataFrame(captures, "id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp"))
    got = {r["id"]: (r["blocked"], r["pattern"], r["since"]) for r in out.collect()}
    weight = {"remove": 0, "allow": 1, "block": 2}
    for i, url, t in captures:
        parts = url.split("@")[1].split(":")[0].split(".")
        want = (False, None, None)
        for k in range(max(1, len(parts) - 1)):
            p = ".".join(parts[k:])
            active = [(at, weight[a]) for q, a, at in entries if q.lower() == p and at <= t]
            if active and max(active)[1] > 0:
                want = (max(active)[1] == 2, p, max(active)[0])
                break
        assert got[i] == want, (i, url, t)


def test_edge_cases(spark):
    captures = spark.createDataFrame([(None, DAY, 1), ("nonsense", DAY, 1), ("http://a.b.c/", None, 1), ("http://a.b.c/", DAY, 1), ("http://a.b.c/", DAY, 1), ("http://A.B.C", DAY - dt.timedelta(seconds=1), 1)], "url string, fetched_at timestamp, blocked int")
    entries = spark.createDataFrame([("b.c", "block", DAY), ("b.c", "allow", DAY), (None, "block", DAY), ("b.c", None, DAY), ("a.b.c", "block", None), ("c", "block", DAY)], "pattern string, action string, listed_at timestamp")
    out = judge_urls(captures, entries)
    assert out.columns == ["url", "fetched_at", "blocked", "_blocked", "pattern", "since"]
    assert sorted(r["_blocked"] for r in out.collect()) == [False] * 4 + [True] * 2
    assert judge_urls(captures, entries.limit(0)).where("_blocked").count() == 0
    assert judge_urls(captures.limit(0), entries).count() == 0


def test_addresses_and_long_urls(spark):
    captures = spark.createDataFrame([("http://10.168.1.1:8080/x", DAY), ("https://[2001:db8::1]/", DAY), ("http://a.b.c/" + "p" * 1_000_000, DAY)], "url string, fetched_at timestamp")
    entries = spark.createDataFrame([("168.1.1", "block", DAY), ("1.1", "block", DAY), ("[2001:db8::1]", "block", DAY), ("b.c", "block", DAY)], "pattern string, action string, listed_at timestamp")
    got = {r["url"][:9]: (r["blocked"], r["pattern"]) for r in judge_urls(captures, entries).collect()}
    assert got == {"http://10": (False, None), "https://[": (True, "[2001:db8::1]"), "http://a.": (True, "b.c")}


def test_far_dates_cost_no_more(spark):
    """Open entries and captures in 9999 or 1601: an interval is worth the captures that it judges, not the months between."""
    import time

    far, old = dt.datetime(9999, 12, 31), dt.datetime(1601, 1, 1)
    entries = [(f"h{i}.org", ("block", "allow")[i % 2], DAY + dt.timedelta(days=i)) for i in range(20)] + [("h3.org", "block", old), ("h4.org", "remove", dt.datetime(2100, 1, 1))]
    captures = [(i, f"http://h{i % 20}.org/", DAY + dt.timedelta(days=i)) for i in range(200)] + [(1000 + i, f"http://h{i}.org/", t) for i in range(6) for t in (far, old)]
    a, b = spark.createDataFrame(captures, "id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp")
    judge_urls(a.limit(5), b).collect()
    begun = time.time()
    got = sorted((r["id"], r["fetched_at"], r["blocked"], r["since"]) for r in judge_urls(a, b).collect())
    took = time.time() - begun
    want = []
    for i, url, t in captures:
        active = [(at, action) for host, action, at in entries if f"http://{host}/" == url and at <= t]
        last = max(active, default=(None, "remove"))
        want.append((i, t, last[1] == "block", last[0] if last[1] != "remove" else None))
    assert got == sorted(want, key=lambda w: w[:2]) and took < 20


def test_many_entries_of_one_pattern(spark):
    """Entries by the minute of one host, and months without any: the entry that holds is carried into them."""
    entries = [("x.org", ("block", "allow", "remove")[i % 3], DAY + dt.timedelta(minutes=37 * i)) for i in range(3_000)]
    captures = [(i, "http://x.org", DAY + dt.timedelta(hours=i * 5 - 40)) for i in range(1_500)]
    out = judge_urls(spark.createDataFrame(captures, "id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp"))
    for r in out.collect():
        active = [(at, a) for _, a, at in entries if at <= r["fetched_at"]]
        last = max(active, default=(None, "remove"))
        assert (r["blocked"], r["since"]) == (last[1] == "block", last[0] if last[1] != "remove" else None)
