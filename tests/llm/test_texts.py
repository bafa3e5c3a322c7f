"""Operators 1, 3, 4, 7, 8 and 9 against brute force, round trips and held-out accuracy."""

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuegrain.llm import chat_format as C
from cuegrain.llm import html_extract as H
from cuegrain.llm import media as M
from cuegrain.llm import mixing as X
from cuegrain.llm import queries as Q
from cuegrain.llm import toxicity as Y
from cuegrain.llm import url_filter as U

SMALL = "/root/testdata/sf0.001"


# --- mixing ---------------------------------------------------------------------------------------


def mix_docs(spark, sizes=(900, 20_000, 300, 5_000, 9_000)):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        left = size
        while left > 0:
            k = min(left, 1 + (n * 37) % 400)
            rows.append((n, " ".join(f"w{j}" for j in range(k)), None if s == 4 else f"s{s}", "x", 1))
            left -= k
            n += 1
    rows += [(n, None, "s0", "x", 1), (n + 1, " \n", "s1", "x", 1), (n + 2, "one", "empty", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")


def test_targets(spark):
    def plan(pairs):
        return {r.source: r.target for r in X.source_targets(spark.createDataFrame(pairs, "source string, source_size long")).collect()}

    assert plan([("b", 100), ("a", 100), (None, 100)]) == {"a": 50.0, "b": 100.0, None: 150.0}
    got = plan([("a", 1000), ("b", 10), ("c", 10)])
    assert got["b"] == 30 and got["c"] == 30 and got["a"] == pytest.approx(960)
    assert plan([("a", 0)]) == {"a": 0.0} and plan([]) == {}


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{i:05}": int(x) for i, x in enumerate(rng.pareto(0.6, 500) * 10 + 1)}
    got = {r.source: (r.s, r.target) for r in X.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()}
    left, free, want = sum(sizes.values()), {n: (1, 2, 3)[i % 3] for i, n in enumerate(sorted(sizes))}, {}
    while over := [n for n in free if left * free[n] / sum(free.values()) > 3 * sizes[n]]:
        for n in over:
            want[n] = 3 * sizes[n]
        left = sum(sizes.values()) - sum(want.values())
        free = {n: w for n, w in free.items() if n not in want}
    want |= {n: left * w / sum(free.values()) for n, w in free.items()}
    assert [got[n][0] for n in sorted(sizes)] == list(range(500))
    assert {n: t for n, (_, t) in got.items()} == pytest.approx(want)


def test_starts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(X, "STRETCH", 4)
    rng, rows = np.random.default_rng(1), []
    for s in range(3):
        for at in rng.choice(100, 30, replace=False).tolist():
            rows.append((s, at, int(rng.integers(0, 9))))
    got = {(r.s, r.at): r.start for r in X._start(spark.createDataFrame(rows, "s long, at long, v long"), "s", "at", "v").collect()}
    assert got == {(s, at): sum(v for t, b, v in rows if t == s and b < at) for s, at, _ in rows}


def test_groups_draw_for_their_sources(spark, monkeypatch):
    monkeypatch.setattr(X, "GROUPS", 3)
    got = X.mixed_sizes(mix_docs(spark), block=16, shard_slots=64).toPandas()
    for _, its in got.groupby("source_size"):
        assert abs(its["taken"].sum() - its["target"].iloc[0]) <= 16 and (its["taken"] <= 3 * its["size"]).all()
    recipe = spark.createDataFrame([(s, q) for s, q in enumerate((0, 50, 200, 10, 340))], "s long, quota long")
    drawn = X._draws(recipe, 5, 10, 60, 600, 1).toPandas()
    assert (drawn["drawn"] > 0).all() and drawn.groupby("shard")["drawn"].sum().tolist() == [60] * 10 and 0 not in set(drawn["s"])
    assert abs(drawn.groupby("s")["drawn"].sum()[4] - 340) < 80


def test_mix_of_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(1, "a b c", "x")] * 3 + [(None, "d e", "x")] * 2 + [(2, "w " * 200_000, "y"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (X.mixed_sizes(docs, block=16, shard_slots=64).toPandas() for _ in range(2))
    assert len(one) == 7 and (one["taken"] <= 3 * one["size"]).all() and sorted(one["taken"]) == sorted(two["taken"])
    assert abs(one[one["id"] == 2]["taken"].sum() - one[one["id"] == 2]["target"].iloc[0]) <= 16


def test_mix(spark):
    docs = mix_docs(spark)
    got = X.mixed_sizes(docs, block=16, shard_slots=64).toPandas()
    again = X.mixed_sizes(docs.repartition(3), block=16, shard_slots=64).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("id", ignore_index=True), again.sort_values("id", ignore_index=True))
    texts = {r.doc_id: r for r in docs.collect()}
    got["source"] = [texts[i].source for i in got["id"]]
    assert len(got) == len(texts) and (got["taken"] <= 3 * got["size"]).all()
    assert all(n == len((texts[i].text or "").split()) for i, n in zip(got["id"], got["size"], strict=True))
    for _, its in got.groupby("source", dropna=False):
        assert its["source_size"].iloc[0] == its["size"].sum()
        assert abs(its["taken"].sum() - its["target"].iloc[0]) <= 16


def test_slots_cover_their_blocks_once_a_pass(spark):
    rows, taken = X.mix(mix_docs(spark), block=16, shard_slots=64)
    per_word = taken.select("row", "pass", F.explode(F.sequence("first", F.col("first") + F.col("words") - 1)).alias("w"))
    assert per_word.groupBy("row", "pass", "w").count().where("count > 1").count() == 0
    assert taken.select(F.max("pass")).first()[0] <= 2
    assert taken.select("shard").distinct().count() > 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations(n):
    image = X.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
    assert sorted(image.tolist()) == list(range(n))
    assert n < 10 or image.tolist() != list(range(n))


def test_mixed_documents_hold_the_taken_words(spark):
    docs = mix_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    mixed = X.mixed_documents(docs, block=16, shard_slots=64)
    assert mixed.columns == docs.columns
    sizes = X.mixed_sizes(docs, block=16, shard_slots=64).select("id", "taken").toPandas().set_index("id")["taken"].to_dict()
    by = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        by[r.doc_id] = by.get(r.doc_id, 0) + len(r.text.split())
    assert by == {i: n for i, n in sizes.items() if n}
    assert X.mixed_documents(docs.where("false")).count() == 0


# --- urls -----------------------------------------------------------------------------------------

URLS = ["http://A.Example.COM/en/1?x=/y#z", "https://www.example.com/en/", "https://x.www.example.com/en/q", "ftp://example.com/EN/", "http://example.com", "http://com/", "http://telecom/", "http://a.net/es/x", "http://a.net/fr", "http://net/fr/", "x://y://z/p", "nothing", "", None, "http://h?q/r", "http://h#/r", "://", "http://É.org/p", "a\nb://h/\np"]


def rule_of(host, path):
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    got = {r.id: r for r in U.url_verdicts(pages).collect()}
    model = U.train()
    for i, u in enumerate(URLS):
        host, path = U.split_url(u)
        assert (got[i].host, got[i].path) == (host, path)
        best = rule_of(host, path)
        p = model.probability(model.part(host, "h"), model.part(path, "p"))
        assert got[i].rule == (best[0] if best else None)
        assert got[i].verdict == (best[1] if best else "block" if p >= 0.5 else "allow")
    assert got[0].rule == "example.com/en/" and got[1].verdict == "allow" and got[6].rule is None and got[4].rule is None
    assert U.url_verdicts(pages.where("false")).count() == 0


# Sites of names that the labelled table lacks: its precision and recall on them stand in the README.
UNSEEN_UNWANTED = """http://grand-casino-nights.com/tables http://pokerstarsclub.net/en/4 https://bets-of-the-day.org/tips https://slotsmania.com/fr/2 https://cheap-tablets.example.org/buy
http://meds-without-prescription.net/ https://diet-pills-store.com/de/9 http://adult-webcams.org/en/1 https://sexy-singles-chat.com/join http://xxx-movies.net/es/5 https://instant-cash-loan.org/apply
http://crypto-profit-now.com/invest https://seo-links-market.net/order http://spamlinks.org/en/44 https://ads-banner-network.com/serve http://clicktracking.net/redirect?id=4 https://replica-bags-sale.com/
http://keygen-crack-download.org/full https://claim-your-prize.net/winner http://secure-login-verify.com/account""".split()
UNSEEN_ORDINARY = """https://eveningpost.com/world/treaty http://www.villagenews.org/en/sports https://chemistry.institute.edu/lectures http://nationalarchive.gov/records/1850 https://docs.compiler.io/reference/types
http://breadbakers.net/recipes/rye https://mountainhuts.org/routes/north http://stadtmuseum.de/de/ausstellung https://ecole-du-sud.fr/fr/cours http://universidad.es/es/noticias/41 https://stringquartet.org/concerts
http://bookreview.net/novels/2020 https://rowingclub.com/results http://hospitaltrust.org/visitors https://geology.edu/maps/coast http://oakfurniture.com/chairs https://blog.thering.example.org/en/5.html
http://www.ththat.example.net/de/410 https://ththin.example.com/en/3 http://m.ousely.org/es/77 https://eaux-reau.example.net/fr/9 http://inerly.com/en/2024/a?page=2 https://nicht-aulich.de/de/7 http://asonci.net/12""".split()


def test_url_model_on_unseen_names():
    m = U.train()
    p = lambda u: m.probability(*(m.part(x, k) for x, k in zip(U.split_url(u), "hp", strict=True)))
    hosts = {U.split_url(u)[0] for u, _ in U.labelled_urls()}
    assert not hosts & {U.split_url(u)[0] for u in UNSEEN_UNWANTED + UNSEEN_ORDINARY}
    caught, wrong = sum(p(u) >= 0.5 for u in UNSEEN_UNWANTED), sum(p(u) >= 0.5 for u in UNSEEN_ORDINARY)
    assert caught >= 0.75 * len(UNSEEN_UNWANTED) and wrong <= 0.05 * len(UNSEEN_ORDINARY)


# FROZEN: written before the table got its sites, but its result (19 of 24, 1 of 28) was known when the bias was chosen by cross-validation.
# SECOND: written before that choice and used for nothing. Their figures stand in the README.
FROZEN_UNWANTED = """http://luckyspin-casino.biz/signup https://holdem-poker-room.net/ https://sportsbet365.info/odds https://mega-jackpot-slots.com/play https://order-viagra-now.biz/ http://cheapmeds24.net/cialis
https://onlinepharmacy-discount.com/pills https://porn-tube.example.net/watch http://hotgirls-cams.net/live https://escorts-in-town.com/ http://payday-advance.biz/apply https://quickloans-nocheck.com/
https://bitcoin-doubler.net/invest https://forex-signals-profit.com/ http://buy-backlinks-cheap.net/ https://popunder-traffic.com/ http://adserve-tracker.net/pixel.gif https://replica-watches-outlet.com/
http://serials-keygen.net/crack https://free-torrents-download.net/ https://freegiftcard-survey.com/claim http://youhavewon-prize.info/ https://paypal-login-verify-account.com/ https://miracle-weightloss.net/diet""".split()
FROZEN_ORDINARY = """https://drug-information.health.gov/interactions https://trackandfield-club.org/results https://sussex-and-middlesex.gov.uk/council https://betterhomes.com/kitchen https://alphabet-books.com/children
https://scunthorpe-times.co.uk/news https://camera-museum.org/exhibitions https://creditunion-history.org/archive https://clickertraining-dogs.com/guide https://advertiser-tribune.com/local https://freedomtrail.org/map
https://winery-tours.fr/fr/vins https://slotcar-racing.org/club https://pillow-and-linen.com/shop https://farmersmarket.org/stalls https://tablet-weaving.org/patterns https://lotus-garden.de/de/rezepte
https://prizewinning-novels.org/2021 https://cheapside-church.org/history https://mathcurves.org/wiki/Roulette https://software-docs.dev/api https://stadtbibliothek.de/de/katalog https://www.lejournal-diplo.fr/fr/article
https://biochem.university.edu/courses https://riverside-hospital.org/visit https://localweather.net/forecast https://chesspuzzles.org/daily https://openstreetatlas.org/edit""".split()
SECOND_UNWANTED = """https://texas-holdem-bonus.net/lobby http://spinpalace-casino.info/ https://livebetting-odds.com/tennis http://bigwin-lottery.biz/tickets https://cheap-cialis-pharmacy.com/ http://diazepam-no-prescription.net/buy https://keto-diet-pills.info/order
https://amateur-sex-videos.net/watch http://nude-webcam-chat.com/ https://sexdating-local.biz/join http://instant-payday-cash.net/ https://crypto-invest-returns.com/signup https://passive-income-robot.net/ http://seo-spam-links.biz/ https://bulk-traffic-clicks.net/buy
http://banner-ads-server.com/click https://track-affiliate-clicks.net/r https://fake-rolex-replica.net/ http://cracked-games-torrent.com/download https://win-prize-survey.net/claim http://bank-login-verify.info/secure https://free-bonus-giveaway.biz/""".split()
SECOND_ORDINARY = """https://pharmacists-society.org/members https://racetracks-of-france.fr/fr/histoire https://middlesexlibrary.org/hours https://betacarotene.edu/papers https://campsites-guide.nl/kaart https://freeholdtownship.gov/council https://windsurfing-school.com/lessons
https://creditonriver.com/walks https://adaptive-optics.edu/lectures https://clicquot-museum.fr/fr/visite https://tablelands-farm.com/stalls https://linkage-genetics.edu/maps https://poetrymagazine.org/issues https://stadttheater.de/de/spielplan https://cyclingroutes.org/alps
https://ceramics-studio.com/courses https://observatory.edu/planets https://townhall.gov/minutes https://violinmakers.org/history https://bakerystreet.com/menu https://opencompiler.dev/manual https://naturalhistory.museum/fossils https://coastguard.gov/forecast https://novelists.org/awards""".split()


@pytest.mark.parametrize(("unwanted", "ordinary"), [(FROZEN_UNWANTED, FROZEN_ORDINARY), (SECOND_UNWANTED, SECOND_ORDINARY)], ids=["frozen", "second"])
def test_url_model_on_urls_written_before_the_table(unwanted, ordinary):
    m = U.default_model()
    p = lambda u: m.probability(*(m.part(x, k) for x, k in zip(U.split_url(u), "hp", strict=True)))
    assert not {U.split_url(u)[0].removeprefix("www.") for u, _ in U.labelled_urls()} & {U.split_url(u)[0].removeprefix("www.") for u in unwanted + ordinary}
    caught, wrong = sum(p(u) >= 0.5 for u in unwanted), sum(p(u) >= 0.5 for u in ordinary)
    assert caught >= 0.8 * len(unwanted) and caught >= 0.8 * (caught + wrong)


def test_labelled_urls_are_no_pages_of_the_tables(spark):
    hosts = {r.host for r in spark.read.parquet(f"{SMALL}/pages.parquet").select(U.host_of(F.col("url")).alias("host")).collect()}
    assert not hosts & {U.split_url(u)[0] for u, _ in U.labelled_urls()}


def test_a_labelled_table_and_odd_urls(spark):
    labelled = spark.createDataFrame([(f"http://bad{i}.net/zzz", 1) for i in range(9)] + [(f"http://good{i}.net/aaa", 0) for i in range(9)] + [(None, 1), ("http://x/", None), ("http://bad1.net/zzz", 1)], "url string, label int")
    assert len(U.labelled_rows(labelled)) == 18
    rows = [(1, "http://bad77.org/zzz"), (1, "http://bad77.org/zzz"), (2, "http://good77.org/aaa"), (3, "http://h.org/" + "q" * 500_000), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = U.url_verdicts(pages, labelled=labelled).collect()
    assert len(got) == 5 and [r.verdict for r in got if r.id == 1] == ["block"] * 2 and [r.verdict for r in got if r.id == 2] == ["allow"]
    assert [len(r.path) for r in got if r.id == 3] == [500_001] and U.train(()).weights.sum() == 0


# --- html -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style></head><body class="menu-open"><header class="top"><h1>Site</h1></header><nav><a href=/>Menu</a></nav>
<div class="cookie-notice"><p>We use cookies, very long text about cookies that nobody ever wants to read at all, really.</p></div>
<div class="main x12"><div class="post-9"><h2>Ti&amp;tle &#233;</h2><p>First <b>para</b>graph<br>goes   on, with 1 &lt; 2 and a <a href="#">link</a>.<p>Second one &copy; here.<ul><li>item one<li>item two</ul><script>var t="</p>";</script><!-- <p>no</p> --></div>
<div id="comments"><p>Reader comment that is quite long and would otherwise count as a text of its own.</p></div></div>
<form><p>Sign up</p></form><aside><p>Side</p></aside><footer>Foot</footer></body></html>"""
WANT = "Ti&tle é\n\nFirst paragraph goes on, with 1 < 2 and a link.\n\nSecond one © here.\n\nitem one\n\nitem two"


def test_page_text():
    page = H.Page(PAGE)
    path, _ = page.best()
    assert page.name(path).endswith("div.main.x#/div.post-#") and page.text(path) == WANT


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<article><h1>A</h1><p><b>x<br><p>y</p></article><footer>f", "A\n\nx\n\ny"), ("<div><p>cut off <b>he", "cut off he"), ("<nav>only a menu</nav>", ""), ("<p>a < b</p>", "a < b"), ("<article>" + "<p>x</p>" * 3000 + "</article>", "\n\n".join(["x"] * 3000))])
def test_odd_pages(spark, html, text):
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert H.extract_text(df).first().text == text


@pytest.mark.parametrize(
    "html,parts",
    [
        ("<body><nav>menu</nav><article><h1>Title</h1><div class=intro>{0}</div><div class=body>{1}</div></article><div>extra</div></body>", ["Title", 0, 1]),
        ("<body><main><section class=a><h2>One</h2><p>{0}</p></section><section class=b><h2>Two</h2><p>{1}</p></section></main></body>", ["One", 0, "Two", 1]),
        ("<body><article><h1>Title</h1><p>{0}</p><blockquote>{1}</blockquote><p>after</p></article></body>", ["Title", 0, 1, "after"]),
        ("<body><div class='w-1/2'><h1>Title</h1><div class=intro>{0}</div><table><tr><td>{1}</td></tr></table></div><div class=more>extra</div></body>", ["Title", 0, 1]),
        ("<body><h1>Title</h1><p>{0}</p><blockquote>{1}</blockquote></body>", ["Title", 0, 1]),
        ("<body><div class=out><div class=list><a href='/x'>{0}</a></div><div class=body>{1}</div></div></body>", [1]),
    ],
)
def test_whole_article_is_kept(spark, html, parts):
    texts = ("short words of an intro. " * 4).strip(), ("long words of the body. " * 24).strip()
    df = spark.createDataFrame([(1, "http://h/", html.format(*texts))], "page_id long, url string, html string")
    assert H.extract_text(df).first().text == "\n\n".join(texts[p] if isinstance(p, int) else p for p in parts)


ARTICLE = "<h1>Title</h1><p>" + "A long text of an article goes on and on. " * 12 + "</p><p>And it ends here.</p>"
ARTICLE_TEXT = "Title\n\n" + ("A long text of an article goes on and on. " * 12).strip() + "\n\nAnd it ends here."


@pytest.mark.parametrize(
    "html",
    [
        "<div class='content-with-sidebar'>{}<div class='sidebar'><p>Side text of the page.</p></div></div>",
        "<div class='wrap sidebar-right'>{}</div><div class='widget'><p>Widget.</p></div>",
        "<article id='search-engines'>{}</article>",
        "<form action='/'><div class='x'>{}</div><label>Name</label><input><button>Go</button></form>",
        "<article><div class='entry-header'>{}</div><div id='comments'><p>Reader comment, rather long for what it says.</p></div></article>",
        "<div class='popup-page'><main>{}</main></div><div class='cookie'><p>We use cookies.</p></div>",
        "<div role='navigation'><p>Go there.</p></div><div>{}</div><div hidden><p>Unseen.</p></div><div style='display: none'><p>Unseen.</p></div>",
    ],
)
def test_the_vote_and_not_a_word_decides(spark, html):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", html.format(ARTICLE)) for i in range(2)], "page_id long, url string, html string")
    assert [r.text for r in H.extract_text(df).collect()] == [ARTICLE_TEXT] * 2


def test_paragraphs_named_for_what_they_say_stay():
    page = H.Page("<article><p class='related-work'>Related work is cited.</p><p class='ad'>Buy now.</p><div class='related'><p>More to read.</p></div><p>" + "text " * 50 + "</p></article>")
    assert page.text(page.best()[0]) == "Related work is cited.\n\n" + ("text " * 50).strip()


def plain_article(html):
    """The text of a small well-formed page by a plain walk: blocks of the one article, without what is dropped or marked."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.now = [], [], []

        def end_block(self):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in H.BLOCK:
                self.end_block()
            if tag == "br":
                self.now.append(" ")
            elif tag not in H.VOID:
                self.open.append((tag, tag in H.DROPPED or any(k in ("class", "id") and v in ("ad", "comments") for k, v in attrs)))

        def handle_endtag(self, tag):
            if tag in H.BLOCK:
                self.end_block()
            assert self.open.pop()[0] == tag

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.open) and not any(gone for _, gone in self.open):
                self.now.append(data)

    walk = Walk()
    walk.feed(html)
    return "\n\n".join(walk.out)


def test_small_pages_against_a_plain_walk(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(60):
        inside = ["<h1>T&amp;t {}</h1>"] + [str(rng.choice(["<p>a {} <b>bold</b> word &eacute;<br>x</p>", "<div class=part><p>part {}</p></div>", "<ul><li>item {}</li><li>two</li></ul>", "<div class='ad'>buy {}</div>", "<blockquote><p>said {}</p></blockquote>", "<script>x({})</script>", "<div id='comments'><p>reader {}</p></div>", "<table><tr><td>cell {}</td><td>c</td></tr></table>"])) for _ in range(8)] + ["<p>" + "words of the text " * 20 + "{}</p>"]
        html = f"<html><body><nav><a href='/'>m</a></nav><div class='ad'>ad</div><article>{''.join(x.format(rng.integers(99)) for x in inside)}</article><footer>f</footer></body></html>"
        rows.append((i, f"http://h{i % 3}.org/{i}", html))
    got = {r.id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: plain_article(html) for i, _, html in rows}


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "deep", "<font>" * 100_000 + "<p>x" * 1000, "<div class='a'>" * 50_000 + "</span>" * 50_000 + "y", "<a href=x>" * 100_000 + "z", "<p>" * 100_000 + "w", "<span hidden>" * 50_000 + "<p>" * 50_000, "<a \"" * 100_000, "<h1>x" * 50_000, "<a b='" * 50_000 + ">"])
def test_odd_pages_take_linear_time(html):
    import time

    began = time.process_time()
    page = H.Page(html)
    best = page.best()[0]
    text = page.text(best) if best is not None else ""
    page.keys()
    assert time.process_time() - began < 5 and len(text) <= len(html)


def test_hosts_agree_on_a_path(spark):
    page = "<body><div class='story'><p>{}</p></div><div class='extra'><p>{}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format("the story of the day goes on for long " * 3, "more")) for i in range(5)]
    rows.append((9, "http://h.org/9", page.format("short story", "an extra text that is much longer than the story of this page " * 4)))
    rows += [(10, None, "<p>alone</p>"), (10, None, "<p>alone</p>"), (None, "http://k/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    got = H.extract_text(df).collect()
    assert len(got) == 9 and {r.text for r in got if r.id == 9} == {"short story"} and [r.text for r in got if r.id == 10] == ["alone"] * 2
    assert H.extract_text(df.where("false")).count() == 0


# --- toxicity -------------------------------------------------------------------------------------


def toxic_corpus(spark, n=1200):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        w = [f"{a}{b}" for a, b in zip(rng.choice(["ta", "ron", "mel", "dis", "ka"], 120), rng.choice(["na", "lor", "vi", "gus"], 120), strict=True)]
        if toxic := i % 3 == 0:
            for j in rng.choice(120, 4):
                w[j] = "blorgh" + str(rng.choice(["", "s", "ed", "ing", "er", "est"]))
        docs.append((i, " ".join(w), 9.0, "p"))
        labels.append((i, 1, int(toxic)))
    docs += [(n, "", 9.0, "p"), (n + 1, None, 9.0, "p"), (n + 2, "unseen: Blorghify! " * 6 + "ta na " * 30, 9.0, "p"), (n + 3, "ka lor " * 50_000, 9.0, "p"), (None, "ka lor", 9.0, "p")]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, predicted string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = toxic_corpus(spark)
    return docs, labels, Y.toxicity(docs, labels).toPandas()


def test_toxicity_held_out(judged):
    _, labels, got = judged
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    its = got.set_index("id")
    assert set(its[its["held_out"].astype(bool)].index.dropna()) >= set(held)
    right = [its.loc[i, "predicted"] == (i % 3 == 0) for i in held]
    assert np.mean(right) > 0.97
    assert its["score"].between(0, 1).all() and (its["predicted"] == (its["score"] >= 0.5)).all()
    assert its.loc[1202, "predicted"] == 1 and its.loc[1203, "predicted"] == 0
    assert its.loc[1200, "score"] == its.loc[1201, "score"]


def test_toxicity_does_not_see_the_held_out_fold(spark, judged):
    docs, labels, got = judged
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = Y.toxicity(docs, flipped).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("id", ignore_index=True), again.sort_values("id", ignore_index=True))


def test_repeated_ids_stay_within_the_sample(spark):
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}") for i in kept] + [(kept[k], f"other {k} {j % 30}") for k in range(20) for j in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")  # most without a document
    few = Y.training_rows(docs, labels, per_class=12).toPandas()
    assert few.groupby("label").size().to_dict() == {0: 12, 1: 12} and len(few.drop_duplicates()) == 24
    whole = Y.training_rows(docs, labels, per_class=10_000).toPandas()
    assert len(whole) == len(set(rows)) and set(zip(whole["id"], whole["text"], strict=True)) == set(rows)


def test_a_large_class_is_cut_by_its_hashes_first(spark):
    keys = spark.createDataFrame([(i, int(i % 100 == 0), i) for i in range(3000)] + [(7, 0, 10_000 + i) for i in range(200)], "id long, label int, hash long")
    low = Y._first_hashes(keys, 20)
    n = {r.label: r["count"] for r in low.groupBy("label").count().collect()}
    assert n[1] == 30 and 40 <= n[0] < 400
    first = [r.id for r in keys.where("label = 0").select("id").distinct().orderBy(F.xxhash64("id")).limit(20).collect()]
    assert set(first) <= {r.id for r in low.where("label = 0").collect()}
    hot = spark.createDataFrame([(7, 0, i) for i in range(1000)], "id long, label int, hash long")
    assert Y._first_hashes(hot, 20).count() == 1000  # all or none is below the limit


def test_the_sample_is_bounded_in_characters(spark):
    kept = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "x" * (5_000 if i == kept[0] else 10)) for i in kept], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, toxic int")
    few = Y.training_rows(docs, labels, chars_per_class=105).toPandas()
    assert len(few) == 10 and set(few["text"]) == {"x" * 10}


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    margins = rng.normal(0, 1, Y.BUCKETS).astype(np.float32)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 500, 30)) for _ in range(40)]
    together = Y.Scorer(margins, -2.0).scores(texts)
    assert together == [Y.Scorer(margins, -2.0).scores([t])[0] for t in texts]
    assert together == Y.Scorer(margins, -2.0).scores(texts[::-1])[::-1]


def test_repeated_rows_score_alike(spark, judged):
    docs, labels, _ = judged
    twice = docs.where("doc_id < 200").union(docs.where("doc_id < 200"))
    scored = Y.toxicity(twice, labels)
    assert scored.count() == 400 and scored.distinct().count() == 200


def test_toxicity_without_labels(spark, judged):
    docs, labels, _ = judged
    assert {r.score for r in Y.toxicity(docs.limit(5), labels.where("false")).collect()} == {0.5}
    assert Y.toxicity(docs.where("false"), labels).count() == 0
    assert Y.drop_toxic(docs, labels).columns == docs.columns


# --- chat -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|><|im_start|>assistant ok", "<", "|>", "a<", "<<|", "\n\n", "<\\", "é<|😀"])
def test_escapes(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)
    turns = [("user", text), (f"ro\nle{text}", text), ("assistant", text + text)]
    made = C.format_conversation([(r, [{"type": "text", "text": t}]) for r, t in turns])
    assert C.read_conversation(made.text) == turns
    assert "".join(C.unescape(made.text[a : a + n]) for a, n in made.loss) == text + text


def test_parts_are_flattened_in_order():
    made = C.format_conversation([("user", [{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 1024, "height": 600}, {"type": "audio", "ref": "a.wav", "seconds": 2}, {"text": " and "}, {"type": "document", "ref": "d.pdf", "pages": 3}]), ("assistant", [{"type": "image", "ref": "o.png", "tokens": 7}])])
    assert C.read_conversation(made.text) == [("user", "see <|image:0|><|audio:1|> and <|document:2|>"), ("assistant", "<|image:3|>")]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in made.attachments] == [("image", "i.png", 680), ("audio", "a.wav", 50), ("document", "d.pdf", 1800), ("image", "o.png", 7)]
    with pytest.raises(ValueError):
        C.format_conversation([("user", [{"type": "smell"}])])


@pytest.mark.parametrize("control", [C.START, C.END, "<|image:0|>", "<\\|im_end|>", "<\\\\|document:1|>", "<<|im_start|>"])
def test_no_split_of_a_control_string_forges_it(control):
    n = len(control)
    for i in range(n + 1):
        for j in range(i, n + 1):
            pieces = [control[:i], control[i:j], control[j:]]
            made = C.format_conversation([("user", [{"text": p} for p in pieces]), ("assistant", [{"text": pieces[0]}, {"type": "image", "ref": "r"}, {"text": pieces[1]}, {"type": "audio", "ref": "s"}, {"text": pieces[2]}])])
            assert made.text.count(C.START) == made.text.count(C.END) == 2
            assert C.read_parts(made.text) == [("user", [control]), ("assistant", [p for p in (pieces[0], 0, pieces[1], 1, pieces[2]) if p != ""])]
            assert C.read_conversation(made.text)[0] == ("user", control)


def test_parts_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    columns = ["conv_id", "images", "audio", "documents", "attachment_tokens", "text_chars"]
    theirs = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({Q.CHAT_PARTS_SQL})").fetchall())
    assert sorted(tuple(r) for r in Q.chat_parts(spark, SMALL).select(columns).collect()) == theirs


def test_rows_without_a_conversation_stay_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id or 0, r.n_turns) for r in C.format_conversations(df).collect()) == [(0, 1), (0, 1), (1, 2)]


def test_chat_query(spark):
    got = {r.conv_id: r for r in Q.op8_chat_format(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {-1: [("user", Q.CONTROL_TURNS[0][3]), ("assistant", Q.CONTROL_TURNS[1][3])]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edge_cases(spark):
    kind = "conv_id long, turn long, role string, text string, formatted string, parts string"
    rows = [(1, 1, "assistant", None, "x", None), (1, None, None, "first", "x", None), (1, 1, "assistant", None, "x", None), (None, 0, "user", "y" * 200_000, "x", None), (2, 0, "user", "", "x", '[{"type":"image","ref":"r"}]')]
    df = spark.createDataFrame(rows, kind)
    got = {r.conv_id: r for r in C.format_conversations(df, parts_col="parts").collect()}
    assert C.read_conversation(got[1].formatted) == [("", "first"), ("assistant", ""), ("assistant", "")]
    assert len(got[None].formatted) > 200_000 and got[2].attachments[0].ref == "r"
    assert C.format_conversations(df.where("false")).count() == 0


# --- media ----------------------------------------------------------------------------------------


def test_media(spark):
    texts = ["", None, "a" * 64, "a" * 65, "é\n" * 40_000, "same text", "same text"]
    df = spark.createDataFrame([(i, t, "m", "f") for i, t in enumerate(texts)], "doc_id long, text string, media string, feature string")
    got = {r.id: r for r in M.text_media(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    stored = {r.id: bytes(r.media) for r in M.media_column(df).collect()}
    with wave.open(io.BytesIO(stored[3])) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, 128)
    assert hashlib.sha256(stored[4]).hexdigest() == got[4].media_sha256 and len(stored[4]) == got[4].media_bytes
    assert M.text_media(df.where("false")).count() == 0


def plain_fingerprint(payload):
    """The fingerprint by the definition, sample by sample."""
    size, hop = (256, 128) if len(payload) > 256 else (16, 8)
    n = max(1, -(-(len(payload) - size) // hop) + 1)
    x = [(b - 128) / 128 for b in payload] + [0.0] * ((n - 1) * hop + size - len(payload))
    w = [0.5 - 0.5 * np.cos(2 * np.pi * i / (size - 1)) for i in range(size)]
    peaks = []
    for f in range(n):
        frame = np.array([x[f * hop + i] * w[i] for i in range(size)])
        level = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(size) / 256))) for k in range(129)]
        best = [max(range(lo, hi), key=lambda k: (level[k], -k)) for lo, hi in M.GROUPS]
        peaks.append([k if level[k] > np.mean(level) else -1 for k in best])
    pairs = []
    for t in range(n):
        for step in range(1, M.AHEAD + 1):
            for g in range(len(M.GROUPS)):
                for h in (g, (g + step) % len(M.GROUPS)):
                    if t + step < n and peaks[t][g] >= 0 and peaks[t + step][h] >= 0:
                        pairs.append((t, (peaks[t][g] << 10) | (peaks[t + step][h] << 2) | step))
    return sorted(pairs)


@pytest.mark.parametrize("n", [0, 40, 256, 257, 700])
def test_fingerprints_against_their_definition(n):
    payload = M.payload_of("".join(chr(97 + x) for x in np.random.default_rng(n).integers(0, 26, n)).encode())
    times, codes = M.fingerprints(payload)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_fingerprint(payload)


def test_media_in_slices_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(M, "BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["12345", None, "123456", "x" * 50, "1"])], names=["id", "text"])
    assert [p.column(0).to_pylist() for p in M._parts(batch, 1)] == [[0, 1], [2], [3], [4]]
    assert list(M._parts(batch.slice(0, 0), 1)) == []


def test_fingerprints_follow_the_sound():
    t = np.arange(8000)
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f * t / 8000)).astype(np.uint8).tobytes()
    times, codes = M.fingerprints(tone(1000))
    assert (M.peaks(tone(1000))[1:-1, 2] == 32).all()  # 1000 Hz is band 32 of 31.25 Hz
    assert len(times) == len(codes) and (np.diff(times) >= 0).all()
    assert codes.tolist() != M.fingerprints(tone(700))[1].tolist()
    whole = M.peaks(tone(1000) * 80)
    assert (whole[40:-40, 2] == 32).mean() > 0.95  # as in one piece, though cut into chunks


def test_short_media_have_fingerprints_of_their_own():
    texts = ["", "a short text", "another short text", "one line of words. " * 5, "two lines of text. " * 5, "x" * 256]
    found = [M.fingerprints(M.payload_of(t.encode())) for t in texts]
    assert all(len(times) for times, _ in found)
    assert len({(times.tobytes(), codes.tobytes()) for times, codes in found}) == len(texts)


def test_oracle_of_exact_dedup(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    theirs = {r[0]: tuple(r[1:]) for r in con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({Q.OP6_SQL})").fetchall()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in Q.op6_exact_dedup(spark, SMALL).collect()} == theirs
    assert re.fullmatch("[0-9a-f]{64}", next(iter(theirs.values()))[3])


_OWN = "<p>" + "what the article says of its subject. " * 6 + "</p>"
_READER = "<p>" + "a reader says something long and other. " * 20 + "</p>"


@pytest.mark.parametrize("html", ["<article>{0}<div class='side-effects'><p>KEPT</p></div></article>", "<article>{0}<section class='search-and-rescue'><p>KEPT</p></section></article>", "<main>{0}<div id='form-of-government'><p>KEPT</p></div></main>", "<article>{0}<div class='social-history'><p>KEPT</p></div></article>", "<article>{0}<p class='bottom'>KEPT</p></article>"])
def test_names_of_subjects_delete_nothing(html):
    page = H.Page(html.format(_OWN))
    assert "KEPT" in page.text(page.best()[0])


@pytest.mark.parametrize("html", ["<article>{0}<article class='comment'>{1}</article></article>", "<main><article>{0}</article><article class='comment'>{1}</article></main>", "<article>{0}<div class='post-comments'>{1}</div></article>", "<article>{0}<div class='comment-list userComments2'>{1}</div></article>", "<article>{0}</article><section id='disqus_thread'>{1}</section>"])
def test_readers_comments_are_no_article(html):
    page = H.Page(html.format(_OWN, _READER))
    text = page.text(page.best()[0])
    assert "what the article says" in text and "a reader says" not in text


@pytest.mark.parametrize("parts,error", [("null", "parts are no list"), ("not json", "parts are no JSON"), ("[" * 100_000, "parts are no JSON"), ('["hi"]', "part 0: not an object"), ('[{"type":"video"}]', "part 0: unknown kind"), ('[{"type":["text"]}]', "part 0: unknown kind"), ('[{"text":"a"},{"type":"image","width":"wide"}]', "part 1: width is no measure"), ('[{"type":"audio","seconds":NaN}]', "part 0: seconds is no measure"), ('[{"type":"document","pages":-1}]', "part 0: pages is no measure"), ('[{"text":5}]', "part 0: text is no text"), ('[{"text":"\\ud800"}]', "part 0: text is no valid Unicode"), ('[{"type":"image","ref":7}]', "part 0: ref is no text")])
def test_malformed_parts_are_refused(spark, parts, error):
    rows = [(1, 0, "user", "said instead", parts), (1, 1, "assistant", None, '[{"text":"ok"},{"type":"image"}]'), (2, 0, "user", "x", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    got = {r.conv_id: r for r in C.format_conversations(df, parts_col="parts").collect()}
    assert got[1].errors == [f"turn 0: {error}"] and got[2].errors == []
    assert C.read_parts(got[1].formatted) == [("user", ["said instead"]), ("assistant", ["ok", 0])]
