from pyspark.sql import functions as F

from pagewarden.functions import domains as D
from pagewarden.functions import text as X
from pagewarden.operators.classify import biz_type, category_of
from pagewarden.operators.contacts import extract_contacts


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_domains(spark):
    cases = {
        "https://www.Shop.example.com.bd:80/a?b": "example.com.bd", "*.x.y.net": "y.net", "a..b.com": None, "logo.png": None, "facebook.com": None,
        "192.0.2.7": None, "": None, "http://a.b.com.bd/": "b.com.bd", "WWW.Test.ORG.": "test.org",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "u string").select("u", D.registrable(F.col("u")).alias("r")).collect()
    assert {r["u"]: r["r"] for r in rows if r["u"] is not None} == cases and [r["r"] for r in rows if r["u"] is None] == [None]
    assert one(spark, D.host_of(F.col("u")), u="HTTPS://A.b:1/c") == "a.b"
    assert one(spark, D.clean_host(F.col("u")), u="https://me@A.b.:1?q#f") == "a.b"
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    hosts = spark.createDataFrame([("a.b.co.uk",), ("yy.com",), ("co.uk",), ("n.zz",)], "h string")
    got = {r["h"]: r["registrable"] for r in D.registrable_by_suffix(hosts, "h", suffixes).collect()}
    assert got == {"a.b.co.uk": "b.co.uk", "yy.com": "yy.com", "co.uk": "co.uk", "n.zz": None}
    assert one(spark, D.bd_score(F.col("u"), ip_bd=True, source_bd=True, bengali=True), u="a.bd") == 100
    assert one(spark, D.domain_spammy(F.col("u")), u="my-casino.com") and one(spark, D.domain_spammy(F.col("u")), u="a.bet")


def test_identity(spark):
    letters = "ক"
    assert not one(spark, D.bd_signal(F.col("d"), F.col("b")), d="a.com", b=letters * 14)
    assert one(spark, D.bd_signal(F.col("d"), F.col("b")), d="a.com", b=letters * 15)
    assert one(spark, D.bd_signal(F.col("d"), F.col("b")), d="a.com", b="call +8801712345678") and one(spark, D.bd_signal(F.col("d"), F.col("b")), d="x.bd", b="")


def test_text(spark):
    html = "<TITLE>\n A  b </TITLE><script>x</script><p>k&amp;l m</p>"
    assert one(spark, X.strip_html(F.col("t")), t=html) == " A b k l m "
    assert one(spark, X.strip_html_unescaped(F.col("t")), t=html) == "A b k&l m"
    assert one(spark, X.title_of(F.col("t")), t=html) == "A b"
    assert one(spark, X.distinct_matches(F.col("t"), r"\bCasino\b|КАЗИНО"), t="casino éCasino казино CASINO") == ["casino", "казино"]
    assert one(spark, X.gibberish(F.col("t")), t="bcdfghjklm") and not one(spark, X.gibberish(F.col("t")), t="bcdfghjkl")
    schema = "classification string, reason string"
    assert one(spark, X.json_inside(F.col("t"), schema), t='so: {"classification":"a","reason":"b"} ok')["classification"] == "a"
    assert one(spark, X.json_inside(F.col("t"), schema), t="none") is None or one(spark, X.json_inside(F.col("t"), schema), t="none")["classification"] is None
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 17:59:59' a, timestamp_ntz'2024-01-01 18:00:00' b")
    r = rows.select(X.local_day(F.col("a")).alias("a"), X.local_day(F.col("b")).alias("b"), X.local_hour(F.col("b")).alias("h")).first()
    assert (r["a"], r["b"], r["h"]) == ("2024-01-01", "2024-01-02", "2024-01-02-00")


def test_classes(spark):
    assert [one(spark, category_of(F.col("t")), t=t) for t in ("poker", "viagra pills", "porn", "x")] == ["gambling", "pharma", "adult", ""]
    kind = lambda d, t, b: one(spark, biz_type(F.col("d"), F.col("t"), F.col("b")), d=d, t=t, b=b)
    assert kind("x.gov.bd", "", "") == "government" and kind("x.edu.bd", "", "") == "education"
    assert kind("a.com", "", "hospital") == "general-business" and kind("a.com", "", "hospital clinic") == "healthcare"
    assert kind("a.com", "", "school bank school bank") == "education"  # a tie goes by priority
    assert kind("a.com", "", " " * 2500 + "hospital clinic") == "general-business"


def test_contacts(spark):
    rows = [(1, "mail Info@shop.example.net", "Menu About. House 12, Road 5, Dhanmondi, call 01712345678"), (2, "", "Road to nowhere"), (3, None, None),
            (4, "a@example.com", "Sector 7, Sylhet")]
    got = {r["id"]: r for r in extract_contacts(spark.createDataFrame(rows, "id long, h string, t string"), "id", "h", "t").collect()}
    assert (got[1]["area"], got[1]["district"], got[1]["phone"]) == ("Dhanmondi", "Dhaka", "01712345678") and "House 12" in got[1]["address"]
    assert got[2]["address"] == "" and got[3]["phone"] == "" and got[4]["district"] == "Sylhet" and got[4]["email"] == ""


def test_contacts_of_whole_texts(spark, tmp_path):
    from pagewarden.operators.contacts import MOST_TEXT, MOST_WORDS
    from pagewarden.plans import catalog

    long = "word " * 13_000 + "call 01712345678 now"
    rows = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["phone"] for r in catalog.QUERIES["contact_extract"](spark, str(tmp_path)).collect()} == {1: "01712345678", 2: ""}
    far = spark.createDataFrame([(1, "", "road " + "x" * 200 + (" road" + " y" * 90) * 250 + " House 5, Dhanmondi")], "id long, h string, t string")
    assert extract_contacts(far, "id", "h", "t").first()["area"] == "Dhanmondi"
    assert extract_contacts(far, "id", "h", "t", MOST_TEXT, MOST_WORDS).first()["area"] == ""


def test_running_starts(spark):
    from pagewarden.functions.text import running_starts

    rows = [([], []), ([3], [2]), (list(range(50)), [k % 4 for k in range(50)])]
    got = [r[0] for r in spark.createDataFrame(rows, "g array<int>, s array<int>").select(running_starts(F.col("g"), F.col("s"))).collect()]
    for (gaps, sizes), starts in zip(rows, got):
        at, want = 0, []
        for g, n in zip(gaps, sizes):
            want.append(at + g)
            at += g + n
        assert starts == want


def test_alternatives_put_together(spark):
    """The same texts match, whatever the order of the alternatives."""
    from pagewarden.functions import patterns as P

    words = ["judi", "slot gacor", "slot-gacor", "qq slot", "qqslot", "pin-up", "pinup", "owned by the red team", "baji live", "baji88", "viagra", "xviagra", "casinos",
             "casino", "mr. x1 team", "slotonline", "slot-777", "казино", "พนัน", "hacked by", "plain text", "", "ndsw=", "bahissiteleri", "da ga", "dada gaga", "no hu"]
    words += [w.upper() for w in words] + [a + " " + b for a, b in zip(words, words[7:])] + [a + b for a, b in zip(words, words[3:])]
    for pattern in (P.ALL_STRONG, P.ALL_WEAK, P.RX_DEFACE, P.RX_MALJS, P.RX_SLUG_SPAM, P.RX_WAF, r"a|ab?|a*b|(?:c|\\bd)|[|x]y|e{2}"):
        df = spark.createDataFrame([(w,) for w in words], "t string")
        rows = df.select("t", X.has_match(F.col("t"), pattern).alias("fast"), F.col("t").rlike(X.FLAGS + pattern).alias("plain")).collect()
        assert [r["t"] for r in rows if r["fast"] != r["plain"]] == []
    assert X.alternatives("a|(b|c)|[|]|(?:d|e)") == ["a", "(b|c)", "[|]", "d", "e"] and X.by_beginning("ab|ac|b") == "a(?:b|c)|b"


def test_guarded_alternatives(spark):
    """A look at the next character goes before the alternatives; the same texts match, beside letters of other cases too."""
    from pagewarden.functions import patterns as P

    assert X.guarded(r"ab|\bac|b|-c|да|[x]|d?e", few=2) == r"(?=[\-ab])(?:(?=[\-])(?:-c)|(?=[ab])(?:ab|\bac|b))|(?=(?-iu:[^\x00-\x7f]))(?:да)|[x]|d?e"
    lists = (P.ALL_STRONG, P.ALL_WEAK, P.RX_DEFACE, P.RX_MALJS, P.RX_SLUG_SPAM, P.RX_WAF, "İx|ıy|ßz|ſa|Kb|µc|ÿd|σe|ςf|Åg|-h| i|1j")
    words = ["İx", "ix", "ıy", "Iy", "iy", "ßz", "ẞz", "ssz", "ſa", "sa", "SA", "Kb", "kb", "KB", "µc", "μc", "Μc", "ÿd", "Ÿd", "σe", "ςE", "Σf", "Åg", "Åg", "åG", "-h",
             " I", "1j", "ſlot gacor", "Kasino", "KAſINO", "İnto judi", "NỔ HŨ", "Đá Gà", "ⅹxx", "sikiş", "éjudi", "ПЕРВЫЕ СТАВКИ НА СПОРТ", "कैसीनो", "\U0001f3b0judi"]
    for pattern in lists:
        bare = [p.replace("\\b", "") for p in X.alternatives(pattern)]
        rows = spark.createDataFrame([(w,) for p in bare for w in (p, p.upper(), p.swapcase() + " ", "x" + p, p[1:])] + [(w,) for w in words], "t string")
        got = rows.select("t", X.has_match(F.col("t"), pattern).alias("fast"), F.col("t").rlike(X.FLAGS + pattern).alias("plain")).collect()
        assert [r["t"] for r in got if r["fast"] != r["plain"]] == [] and any(r["plain"] for r in got)
