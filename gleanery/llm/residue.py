"""Problem 3: template residue and error-page text.

Method: message templates are mined with a fixed-depth prefix tree: a sentence of a page's main area goes down by its length class and
its first tokens (names behind the first token and digits are wildcards); its leaf, at depth 3, is the template. Leaves that are too rare to
be judged are merged into their parent, where the third token is a wildcard too. Each template is classified once, by where it occurs: a
message stands on pages that hold no running text, ordinary sentences and site furniture stand on pages that do. A fixed list of phrases
of notices is the seed for messages that are too rare to be counted. The verdicts are then propagated to the pages. Unresolved slots
({{name}}, %title%, [INSERT DATE] ...) are found separately inside all records; a slot whose surrounding words recur in different pages that
mostly hold running text besides is quoted by a text about templates and is none. The status code plays no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.pages import _hash
from gleanery.session import cut, discard

DEPTH = 3
#: A page with fewer words of running text than this is bare.
BARE_WORDS = 40
#: A template without such phrases is a message if it stands in so many contexts on bare pages, and this many times oftener there than on others, and as many times rarer on others than its hosts' pages let expect.
MIN_CONTEXTS, RATIO = 5, 3.0

_SLOT = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<%=?[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|\[\[[^\[\]\n]{1,60}\]\]|%[A-Za-z_][\w.]*%|(?<!\w)__[A-Za-z]\w*?(?:\.\w+)*__(?!\w)"
    r"|@@[A-Za-z][\w.]*@@|\[(?:INSERT|YOUR|ENTER|TODO|PLACEHOLDER|ADD)\b[^\]\n]{0,60}\]|(?<!\w):[A-Z][A-Z_.]{2,}:|\{[A-Za-z_][\w.]*\}|&lt;%=?[^%\n]{1,60}%&gt;"
)
_SLOT_MARK = re.compile(r"[{%\[_@:]")
_SLOT_CODE = re.compile(r":[A-Z][A-Z_.]{2,}:")
_EMPTY_VALUE = re.compile(r"\b(?:undefined|null|NaN|None)\b|\[object Object\]")
# The words that nearly every run of Latin dummy text holds.
_DUMMY = frozenset("lorem ipsum dolor amet consectetur adipiscing elit".split())
# Phrases of error pages, notices and default pages in en de fr es it pt nl ru.
_NOTICE = re.compile(
    r"(?i)not found|(?:ca|could|did)n.t find|cannot find|no longer|nothing (?:here|lives|found|to see)|no results|\b(?:page|link|address|file|entry|post|article|section|content)\b.{0,40}\b(?:missing|moved|removed|withdrawn|damaged|expired|nowhere|login)\b"
    r"|access denied|\bforbidden|unauthori[sz]ed|permission|not (?:available|allowed|authori[sz]ed|permitted)|unavailable|\blog ?in\b|\bsign in\b|maintenance|closed for repairs|(?:server|internal|unknown|fatal|unexpected) error|^error\b|bad gateway|tim(?:ed?|e) ?out"
    r"|overloaded|too many (?:requests|visits)|\bblocked\b|captcha|\brobot\b|java ?script|\bscripts?\b|try again|come back later|back soon|webmaster|front page|start page|search instead|something (?:broke|went wrong)|^oops|^whoops|^sorry\b|exception|traceback|^warning:"
    r"|^\W*(?:http |error |code )?(?:40\d|410|429|50[0-4])\W*$|(?:–|-|\|) (?:40\d|410|429|50[0-4])$|first post|hello world|under construction|coming soon|did not answer|has been told|moment,? please|keeps happening|reload"
    r"|nicht gefunden|interner fehler|serverfehler|^fehler\b|verweigert|fehlen ihnen|konnte nicht|kann diese seite|skripte|wartungsarbeiten|gleich (?:wieder )?(?:da|zurück)|verschoben oder gelöscht|nicht (?:verfügbar|mehr vorhanden)"
    r"|introuvable|^erreur|erreur interne|refusé|droits nécessaires|ne s.affiche pas|n.a pas (?:pu|abouti)|a changé ou|a été (?:retirée|supprimée|déplacée)|indisponible pour|n.existe plus|de retour bientôt|revenons|n.est pas disponible"
    r"|no encontrad|^error\b|error interno|denegado|no tiene permiso|en mantenimiento|fue eliminad|no se pudo|volvemos|no disponible|ya no existe"
    r"|non trovata|^errore|errore interno|negato|permessi|in manutenzione|è stato rimosso|non è andata|torniamo|non disponibile|senza script|non esiste più"
    r"|não encontrad|^erro\b|erro interno|negado|não tem permissão|em manutenção|foi removid|não foi possível|voltamos|indisponível|não existe mais"
    r"|niet gevonden|interne fout|^fout\b|geweigerd|geen rechten|onderhoud|is verwijderd|kon niet|zo terug|niet beschikbaar|zonder scripts|bestaat niet meer"
    r"|не найден|внутренняя ошибка|^ошибка|запрещ[её]н|нет прав|скрипт|техническ\w+ работ|обслуживани|удалена|не удалось|скоро верн[её]мся|недоступн|больше не существует"
)
#: The same for text in lower case, and characters whose lower case is all that (?i) makes of them: such text is searched faster.
_LOW_NOTICE = re.compile(_NOTICE.pattern.removeprefix("(?i)"))
_SIMPLE_CASE = re.compile(r"[\x00-\xb4\xb6-\xff\u0400-\u045f\u2010-\u203a]*")
_TOKEN = re.compile(r"\w[\w'’-]*")
_EDGES = ".,:;!?…()[]{}«»“”„\"'–—-·|/"
_SPLIT = re.compile(r" (?:(?<=[.!?…] )|[/|] )")  # lines have single spaces only
#: Upper ends of the classes of length, in words.
_LENGTHS = (1, 2, 3, 6, 12)
_LONG = _LENGTHS[-1] + 1
_CLASS = [bisect_left(_LENGTHS, n) for n in range(_LONG + 1)]


@lru_cache(1 << 16)
def _nodes(head: tuple[str, ...], length: int) -> tuple[int, int]:
    path = []
    for t in head:
        t = t.strip(_EDGES)
        if not t:
            continue
        if t[0].isdigit():
            t = "0"
        elif path and t[0].isupper() and not t.isupper():
            t = "C"
        path.append(t.lower() if t != "C" else t)
    if not path:
        return 0, 0
    root = f"m:{length}:"
    return _hash(root + " ".join(path)), _hash(root + " ".join([*path[: DEPTH - 1], "*"])) if len(path) == DEPTH else 0


def nodes_of(sentence: str) -> tuple[int, int]:
    """The leaf of a sentence in the tree and its parent (0: none)."""
    return _nodes(tuple(sentence.split(None, DEPTH)[:DEPTH]), _CLASS[min(sentence.count(" ") + 1, _LONG)])


def template_of(sentence: str) -> int:
    """The leaf of a sentence."""
    return nodes_of(sentence)[0]


def surroundings(core: list[str], running: list[str]) -> tuple[int, bool]:
    """Of a page with slots: its context, the same for copies and renderings of one template, and whether it holds running text besides the lines with slots."""
    masked = [re.sub(r"\d+", "0", _SLOT.sub("§", x)).lower() for x in core]
    longest = sorted(sorted(set(masked)), key=len, reverse=True)[:2]
    besides = sum(x.count(" ") + 1 for x in running if not _SLOT.search(x))
    return _hash("p:" + "\n".join(longest)), besides >= BARE_WORDS


def has_notice(text: str) -> bool:
    """Whether a phrase of notices stands in the text."""
    return bool(_LOW_NOTICE.search(text.lower()) if _SIMPLE_CASE.fullmatch(text) else _NOTICE.search(text))


def _sentences_of(whole: str, core: list[str]) -> list[str]:
    """The parts of all lines of core (whole: joined by line ends) as _SPLIT makes them, mostly by plain replacements."""
    if " / " in whole and " | " in whole:  # these may overlap
        return [p for x in core for p in _SPLIT.split(x)]
    for end in (". ", "! ", "? ", "… "):
        if end in whole:
            whole = whole.replace(end, end[0] + "\n")
    return whole.replace(" / ", "\n").replace(" | ", "\n").split("\n")


def describe(core: list[str], running: list[str]) -> tuple[int, int, list[dict], list[int], int, bool]:
    """Of a page's main area: words, words of running text, sentences, contexts of slots (0 for none), empty values, dummy text.

    sentences: of a bare page (template, parent, context, notice phrase, running text) each; of others only the nodes of the tree.
    """
    whole = "\n".join(core)
    words = whole.count(" ") + len(core)
    text_words = "\n".join(running).count(" ") + len(running)
    bare = text_words < BARE_WORDS
    sentences: list | dict
    if bare:
        text_lines = set(running)
        parts = [(p, x in text_lines and p.count(" ") >= 3) for x in core for p in _SPLIT.split(x)]
        leaves = [nodes_of(p) for p, _ in parts]
        sentences = {}
        for i, ((leaf, parent), (p, ordinary)) in enumerate(zip(leaves, parts)):
            if leaf:
                around = hash((leaves[i - 1][0] if i else 0, leaves[i + 1][0] if i + 1 < len(leaves) else 0))
                sentences[leaf] = {"template": leaf, "parent": parent, "context": around, "notice": has_notice(p), "text": ordinary}
        sentences = list(sentences.values())
    else:
        met = set()
        for p in _sentences_of(whole, core):
            met.update(_nodes(tuple(p.split(None, DEPTH)[:DEPTH]), _CLASS[min(p.count(" ") + 1, _LONG)]))
        met.discard(0)
        sentences = list(met)
    slots, empty = [], 0
    marked = "{" in whole or "%" in whole or "[" in whole or "__" in whole or "@@" in whole or _SLOT_CODE.search(whole)
    for x in core if marked else ():
        if _SLOT_MARK.search(x) and (found := list(_SLOT.finditer(x))):
            for m in found:
                before, after = _SLOT.sub(" § ", x[: m.start()]), _SLOT.sub(" § ", x[m.end() :])
                left, right = re.findall(r"[^\W\d]+|§", before)[-2:], re.findall(r"[^\W\d]+|§", after)[:3]
                slots.append(_hash(f"s:{' '.join(left)}|{' '.join(right)}".lower()) if len(left + right) >= 3 and "§" not in left + right else 0)
    if "undefined" in whole or "null" in whole or "NaN" in whole or "[object" in whole or "None" in whole:
        empty = sum(len(_EMPTY_VALUE.findall(x)) for x in core)
    dummy = False
    if "psum" in whole or "orem" in whole:
        low = [t.lower() for x in running or core for t in _TOKEN.findall(x)]
        hits = [t for t in low if t in _DUMMY]
        dummy = len(hits) >= 2 and len(hits) * 25 >= len(low) and ("lorem" in hits or "ipsum" in hits)
    filler = sum(len(t) >= 3 and len({re.sub(r"(.)\1+", r"\1", w.lower()) for w in t}) == 1 for t in (_TOKEN.findall(x) for x in core) if t) if bare else 0
    return words, text_words, sentences, slots, empty, dummy or filler > 0


def residue_pages(labelled: DataFrame, min_contexts: int = MIN_CONTEXTS, ratio: float = RATIO) -> DataFrame:
    """page_id of every labelled page (see boilerplate.label) whose main area shows a message, slots or dummy text instead of content.

    A page is listed once however often it was crawled; if one crawl of a page_id is a case, the page_id is. Empty input, empty result.
    """
    about = labelled.select("rec_id", F.coalesce("host", F.lit("")).alias("host"), "about.*").withColumn("bare", F.col("text_words") < BARE_WORDS)
    slots = about.where(F.size("slots") > 0).select("rec_id", "words", "page", "full", F.explode("slots").alias("slot"))
    around = slots.where("slot != 0").groupBy("slot", "page").agg(F.max("full").alias("full"))  # copies once
    quoted = around.groupBy("slot").agg(F.count("*").alias("n"), F.count_if("full").alias("full")).where("n > 1 and full * 2 > n").select("slot", F.lit(True).alias("quoted"))
    open_slots = slots.join(quoted, "slot", "left").where(F.col("quoted").isNull()).groupBy("rec_id").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    unfilled = open_slots.where((F.col("n") >= 2) | (F.col("words") < 60)).select("rec_id")
    plain = about.where(F.col("dummy") | ((F.col("empty") > 0) & ((F.col("empty") * 4 >= F.col("words")) | (F.col("bare") & (F.col("empty") > 1))))).select("rec_id")
    sentences = cut(about.select("rec_id", "host", F.explode("sentences").alias("s")).select("rec_id", "host", "s.*"), "bare-sentences")
    nodes = sentences.select("rec_id", "host", F.explode(F.array("template", "parent")).alias("node"), "context", "notice").where("node <> 0").distinct()
    spread = nodes.select("node", "context").distinct().groupBy("node").agg(F.count("*").alias("contexts"))
    # How many full pages a template would stand on if it kept to the rate of its own hosts: where all pages are bare, being on bare pages says nothing.
    hosts = about.groupBy("host").agg((F.count_if(~F.col("bare")) / F.count("*")).alias("full_share"))
    on_bare = nodes.groupBy("node", "host").agg(F.countDistinct("rec_id").alias("on_bare"), F.max(F.col("notice").cast("int")).alias("notice"))
    met = cut(nodes.select("node").distinct(), "bare-nodes")
    on_full = about.where(~F.col("bare")).select("host", F.explode("nodes").alias("node")).join(met, "node", "left_semi").groupBy("node", "host").agg(F.count("*").alias("on_full"))
    each = on_bare.join(on_full, ["node", "host"], "full").na.fill(0, ["on_bare", "on_full", "notice"]).join(hosts, "host")
    expected = F.sum((F.col("on_bare") + F.col("on_full")) * F.col("full_share")).alias("expected")
    counts = each.groupBy("node").agg(F.sum("on_bare").alias("on_bare"), F.sum("on_full").alias("on_full"), F.max("notice").alias("notice"), expected).join(spread, "node")
    counted = (F.col("contexts") >= min_contexts) & (F.col("on_bare") >= ratio * F.col("on_full")) & (F.col("expected") >= ratio * F.greatest("on_full", F.lit(1)))
    verdict = (
        F.when((F.col("notice") == 1) & (F.col("on_bare") >= F.col("on_full")), "message")
        .when(counted, "message")
        .when(F.col("on_full") > ratio * F.col("on_bare"), "other")
        .otherwise("unknown")
    )
    judged = cut(counts.select("node", "contexts", "on_full", verdict.alias("verdict"), counted.alias("counted")), "judged")
    # A leaf that is too rare to be judged takes the counted verdict of its parent.
    leaf, parent = judged.select(F.col("node").alias("template"), "verdict", "contexts", "on_full"), judged.select(F.col("node").alias("parent"), F.col("counted").alias("merged"))
    rare = (F.col("verdict") == "unknown") & (F.col("contexts") < min_contexts) & (F.col("on_full") == 0)
    said = sentences.join(leaf, "template").join(parent, "parent", "left").withColumn("message", (F.col("verdict") == "message") | (rare & F.coalesce("merged", F.lit(False))))
    votes = said.groupBy("rec_id").agg(F.sum(F.col("message").cast("int")).alias("messages"), F.sum((~F.col("message") & F.col("text")).cast("int")).alias("others"))
    shown = votes.where((F.col("messages") > 0) & (F.col("messages") >= F.col("others"))).select("rec_id")
    return unfilled.unionByName(plain).unionByName(shown).select(F.col("rec_id").alias("page_id")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of raw_pages without real content, whatever their status."""
    from gleanery.llm.boilerplate import corpus, label

    pages, _, found = corpus(spark, sf_dir, texts=False)
    labelled = cut(label(pages, found).select("rec_id", "host", "about"), "labelled-pages")
    discard(pages)
    return residue_pages(labelled)


QUERIES = {"p3_found": p3_found}
