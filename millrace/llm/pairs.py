"""Broken prompt and response pairs (problem 1).

A response is checked, in this order, for being empty, cut (delimiter stacks and endings,
see `endings`), a refusal (an automaton of refusal phrases), a copy (a suffix automaton of
the prompt measures how much of the response it holds) and in another language than asked
for (votes of stopwords). The first that applies is the pair's defect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import write_once
from millrace.llm.endings import WITHHELD, Asked, at_limit, evidence, is_cut, llm_calls, unknown_items

ALNUM = re.compile(r"[\W_]+")
#: The characters of cp1252 that are neither letters nor digits.
NOT_ALNUM = bytes(k for k in range(256) if not bytes([k]).decode("cp1252", "replace").isalnum())
#: Letters that a copied run must have, at most.
RUN = 12
#: Markup; in angles, what is longer than 200 characters must look like a tag with attributes or a comment.
TAG = re.compile(r"<[^<>]{0,200}>|</?[A-Za-z][\w:-]*\s[^<>=]*=[^<>]*>|<![^<>]*>|```\w*|&nbsp;")
#: Words that stand for no value.
NO_VALUE = frozenset({"null", "none", "nil", "na", "nan", "nul", "undefined", "void", "empty", "novalue", "nodata", "noresponse", "noanswer", "noresult", "nichts", "leer", "vide", "aucun", "vacío", "ninguno"})

#: Phrases of a refusal, per language, as letters and digits in lower case split by single blanks.
REFUSALS = """
i can t help with|i cannot help with|i can not help with|i can t assist|i cannot assist|i can t provide|i cannot provide|i can t answer|i cannot answer|i can t do that|i cannot do that|i can t comply|i cannot comply|something i cannot comply with|can t share|can not share details|cannot share details
i can t discuss|i cannot discuss|i can t write|i cannot write|i can t continue with|i can t fulfill|i cannot fulfill|i can t support this|i can t give you|i cannot give you|i can t in good conscience|i won t provide|i won t help|i won t write|i won t answer|i will not provide|i will not help|i will not write|no can do|count me out|can t be of help|cannot be of help|can t be of assistance|i d have to say no|i have to say no|the answer is no i
i won t be able to|i will not be able to|i m not able to|i am not able to|i m unable to|i am unable to|unable to assist|unable to help|unable to comply
i must decline|i have to decline|i decline to|i have to refuse|i must refuse|i refuse to|has been declined|request is declined|was declined|i d rather not|i would rather not|i prefer not to|i prefer to leave this unanswered|leave this unanswered
going to pass on this|i will pass on this|my guidelines|rules i follow|beyond what i may|outside of what i am permitted|not permitted to|not allowed to|i don t feel comfortable|i do not feel comfortable|no answer can be given|not something i will write|not something i can|talk about something else|need another way to get this|against my guidelines|i lack access to|lack the permission
kann ich leider nicht|kann ich dir nicht|kann ich ihnen nicht|kann dazu nichts sagen|kann ich nichts sagen|ich werde das nicht|verweigere ich|ich verweigere|ich muss passen|da muss ich passen|das geht leider nicht|nicht weiterhelfen|nicht behilflich sein|kann ich nicht erfüllen|nicht nachkommen
kann ich nicht helfen|ich kann nicht helfen|kann dabei nicht helfen|kann ihnen nicht|kann dir nicht|muss ich ablehnen|ich muss ablehnen|lehne ich ab|ich lehne ab|nur eine absage|eine antwort nicht möglich|keine auskunft geben|darf ich nicht|darf ich keine|möchte ich mich nicht äußern|nichts dazu schreiben|nicht beantworten|nicht erlaubt|bin nicht befugt
je ne saurais|je ne veux pas répondre|je ne répondrai pas|je ne pourrai pas|je suis dans l incapacité|je suis incapable de|je regrette mais je ne peux|je décline|refuse de répondre|ne puis répondre|impossible de vous aider|impossible de répondre à cette|ne donnerai pas
je ne peux pas vous aider|je ne peux pas répondre|je ne peux pas fournir|je ne peux pas|je ne suis pas autorisé|je ne suis pas en mesure|je dois refuser|je refuse de|il m est impossible|préfère ne pas en parler|je préfère ne pas|aucune réponse ne sera donnée|dépasse ce qui m est permis|ce n est pas possible pour moi
no puedo ayudarte|no puedo ayudarle|no puedo hacer eso|no puedo hacerlo|no puedo cumplir|no puedo atender|no puedo compartir|no puedo escribir|no voy a responder|no voy a ayudar|no te puedo|no le puedo|tengo que negarme|tengo que rechazar|declino|rechazo esta|no soy capaz de ayudar|no podré ayudar|no responderé|lo tengo que dejar sin respuesta
no puedo ayudar|no puedo responder|no puedo proporcionar|no puedo dar|no estoy autorizado|no estoy autorizada|no me es posible|debo rechazar|me niego a|me resulta imposible|prefiero no hablar|prefiero no responder|no habrá respuesta|fuera de lo que se me permite|no se me permite
""".strip()
#: Phrases of a sentence that only comes along with a refusal (regret, grounds, another contact).
BESIDES = """
i hope you understand|contact the owner|ask me something else|conflicts with the usage policy|falls outside of what|expose confidential data|could identify people|may be able to assist|rewording it will not change|without approval|i understand the urgency|thanks for asking|thank you for|sorry|i apologise|i apologize|unfortunately|is there anything else
es tut mir leid|zuständige stelle|den richtlinien widerspricht|vertrauliche daten|leider|bedauerlicherweise|danke für
adressez vous|règles d usage|données confidentielles|merci pour la question|désolé|malheureusement|pardon
consulta con la persona|normas de uso|datos confidenciales|gracias por preguntar|lo siento|lamentablemente|disculpa
""".strip()

#: Frequent function words per language.
STOPWORDS = {
    "en": "the a an and or of to in is are was were be been it its this that these those with for on at by from as if when while although because unless until after before so has have had not no but can could would should will which who what how why our their there each every whereas without about only you your i we they he she into over under per than then once during between within",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine mit für auf aus bei von vom zu zum zur im ist sind war waren wird werden wurde wurden hat haben hatte dass daß wenn falls weil obwohl während nachdem bevor damit sowie sich es sie er wir ihr ich du wie was warum welche welcher nur alle jede jeder jedes sämtliche seit bis nach über unter ohne durch als auch noch schon sofern solange bitte denn dann",
    "fr": "le la les un une des du de et ou où mais ne pas plus avec pour sur dans par au aux en est sont était été être a ont que qui quand lorsque parce car afin si alors tandis avant après depuis sans sous chaque toutes tous tout cette ce ces cet il elle nous vous notre votre son sa ses leur leurs je tu comment pourquoi quels quelles seulement puisse doit sauf environ comme selon voici",
    "it": "il lo gli un uno una di che non con per della delle dei degli del dello sono se allora ogni prima dopo mentre poiché perché anche nel nella nei tutti tutte questo questa come solo deve può senza detto più quando sul sulla dal dalla da al alla ma chi cui suo sua loro nostro nostra si le la in è va",
    "nl": "de het een en of maar niet geen met voor op uit bij van naar is zijn was waren wordt worden werd heeft hebben dat als omdat terwijl nadat voordat zodat zich ze hij wij ons onze ik je hoe wat waarom welke alleen alle elke sinds tot na over onder zonder door ook nog dit deze die kan moet",
    "pt": "os as um uma uns umas do da dos das ou mas não com por para em no na nos nas sobre são foi ser está estão tem têm que quem quando porque se então enquanto antes depois desde até sem cada todos todas toda todo esta este isso nosso nossa seu sua como pelo pela ao também só apenas deve pode",
    "sv": "och att det som en ett på är av för med till den har inte om men var sig så vid från när eller utan innan efter alla bara kan ska måste",
    "pl": "na do nie się że to jest jak po od dla przez przy ale lub czy gdy aby oraz każdy każda tylko musi może jego ich które który która",
    "es": "el la los las un una unos unas de del y o pero no con para por sobre en es son era fue ser estar está están ha han que quien cuando porque si entonces mientras antes después desde hasta sin bajo cada todos todas todo toda esta este estos estas ese esa nosotros nuestro nuestra su sus se lo al como cómo qué qué cuál cuáles solamente pueda debe salvo casi según durante conviene mediante yo tú",
}
SHARED = {w for words in STOPWORDS.values() for w in words.split() if sum(w in v.split() for v in STOPWORDS.values()) > 1}
VOTES = {w: lang for lang, words in STOPWORDS.items() for w in words.split() if w not in SHARED}
HALVES = {w: tuple(lang for lang, v in STOPWORDS.items() if w in v.split()) for w in SHARED}
#: Names of the languages, by which a prompt asks for one.
LANGUAGES = {
    "en": "english|englisch|englische|englischer|auf englisch|anglais|inglés|ingles",
    "de": "german|deutsch|deutsche|deutscher|allemand|alemán|aleman",
    "fr": "french|französisch|französische|französischer|français|francais|francés|frances",
    "es": "spanish|spanisch|spanische|spanischer|espagnol|español|espanol|castellano",
}
ASKED = re.compile(
    r"\b(?:answer|reply|respond|write|explain|translate|translated|translation|say it|antworte|antworten sie|schreibe|übersetze|übersetzen sie|réponds|répondez|écris|écrivez|traduis|traduisez|responde|responda|contesta|escribe|traduce|traduzca)\b[^.!?\n]{0,60}?\b(?:in|into|to|auf|ins|en|al|à|vers)\s+(?:the\s+|l')?(" + "|".join(LANGUAGES.values()) + r")\b",
    re.IGNORECASE,
)
KNOWN = frozenset(VOTES) | frozenset(HALVES)
LANGUAGE_OF = {name: lang for lang, names in LANGUAGES.items() for name in names.split("|")}
NAME_FORMS = frozenset(name + mark for name in LANGUAGE_OF for mark in ("", ":", ",", ".", ";", "?", "!", ")"))
REPEAT_WORDS = frozenset({"repeat", "echo", "recite", "wiederhole", "wiederholen", "répète", "répétez", "repite", "repita", "wieder", "copy"})
REPEAT = re.compile(r"\b(?:repeat|echo|recite|wiederhole|wiederholen sie|répète|répétez|repite|repita|gib (?:nur )?(?:den|die|das) .{0,40} wieder|copy (?:this|the following))\b", re.IGNORECASE)
CODE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _automaton(*lists: tuple[str, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, phrases in lists:
        for phrase in re.split(r"[|\n]", phrases):
            made.add_word(f" {phrase} ", kind)
    made.make_automaton()
    return made


REFUSING = _automaton(("refusal", REFUSALS), ("besides", BESIDES))


def is_empty(response: str | None) -> bool:
    """Nothing to read: null, blank, punctuation, empty markup or a word for no value; `0`, `No` and the like are answers."""
    if response is None:
        return True
    left = ALNUM.sub("", TAG.sub("", response)).lower()
    if left:
        return left in NO_VALUE
    return not any(ord(c) > 0x2190 and not c.isspace() and c not in "​‌‍⁠﻿…“”«»" and not 0x2500 <= ord(c) <= 0x25FF for c in response)


def is_refusal(response: str) -> bool:
    """Every sentence refuses or only comes along with a refusal, and one refuses. Quoted and answered refusals are none."""
    refused = False
    for sentence in SENTENCE.split(response.strip()):
        plain = f" {' '.join(re.findall(r'[^\W_]+', sentence.lower()))} "
        if plain == "  ":
            continue
        kinds = {kind for _, kind in REFUSING.iter(plain)}
        if "refusal" in kinds and not re.search(r"['\"“«‘][^'\"”»’]*$", sentence[: _start(sentence)]):
            refused = True
        elif not kinds:
            return False
    return refused


def _start(sentence: str) -> int:
    """Where an inner quotation starts, or 0."""
    found = re.search(r"(?<=\w\s)['\"“«‘](?=\w)", sentence)
    return found.end() if found else 0


def letters(text: str) -> str:
    """Letters and digits of a text, without case."""
    folded = text.casefold()
    try:
        return folded.encode("cp1252").translate(None, NOT_ALNUM).decode("cp1252")
    except UnicodeEncodeError:
        return ALNUM.sub("", folded)


class SuffixAutomaton:
    """All substrings of a text; built in one pass."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(self.next[q].copy())
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def statistics(self, text: str) -> list[int]:
        """Per position the length of the longest substring of the automaton's text that ends there."""
        state, size, out = 0, 0, []
        follow, link, length = self.next, self.link, self.length
        for c in text:
            while state and c not in follow[state]:
                state = link[state]
                size = length[state]
            if c in follow[state]:
                state = follow[state][c]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def covered(prompt: str, response: str, least: int = RUN) -> tuple[int, int, int]:
    """(not copied after the first copied run, not copied before it, length) of the response, in letters and digits."""
    stats = SuffixAutomaton(prompt).statistics(response)
    n, ends = len(response), 0
    marks = bytearray(n)
    at = n - 1
    while at >= 0:
        if stats[at] >= least and (at == n - 1 or stats[at + 1] != stats[at] + 1):
            marks[at - stats[at] + 1 : at + 1] = b"\x01" * stats[at]
        at -= 1
    first = marks.find(1)
    if first < 0:
        return 0, n, n
    ends = n - first - sum(marks[first:])
    return ends, first, n


def asks_to_repeat(prompt: str, words: list[str]) -> bool:
    return not REPEAT_WORDS.isdisjoint(words) and bool(REPEAT.search(prompt))


def is_copy(prompt: str, response: str) -> bool:
    """The response gives back the prompt, or a part of it, and adds no more than a heading of 30 letters.

    Of fewer than four words (text without blanks, a name picked from the prompt) it must give
    back half of the prompt. The automaton is built for every response that it can find to be a
    copy: the first copied run starts within the heading, so its first RUN letters are looked
    for at each of those places.
    """
    p, r = letters(prompt), letters(response)
    n = len(r)
    if n < 8 or not p or (len(response.split()) < 4 and 2 * n < len(p)):
        return False
    least, heading = min(RUN, n), min(30, n // 2)
    if not any(r[at : at + least] in p for at in range(min(heading, n - least) + 1)):
        return False
    if asks_to_repeat(prompt, prompt.lower().split()):
        return False
    after, before, n = covered(p, r, least)
    return before <= heading and after <= max(2, 0.03 * n)


def votes(text: str) -> dict[str, float]:
    """Votes of stopwords per language for the prose of a text; code, identifiers and markup have none."""
    prose = CODE.sub(" ", text) if "```" in text else text
    found: dict[str, float] = {}
    for word in filter(KNOWN.__contains__, prose.lower().split()):
        lang = VOTES.get(word)
        if lang:
            found[lang] = found.get(lang, 0) + 1
        else:
            for lang in HALVES[word]:
                found[lang] = found.get(lang, 0) + 0.4
    return found


def language(text: str, least: float = 2.4, lead: float = 1.8) -> str | None:
    """The language of the prose, if it has enough votes and `lead` times as many as any other; else None."""
    found = sorted(((n, lang) for lang, n in votes(text).items()), reverse=True)
    if not found or found[0][0] < least or (len(found) > 1 and found[0][0] < lead * found[1][0]):
        return None
    return found[0][1]


def wanted_language(prompt: str) -> str | None:
    """The language a prompt asks for, or else is written in."""
    if not NAME_FORMS.isdisjoint(prompt.lower().split()):
        asked = ASKED.findall(prompt)
        if asked:
            return LANGUAGE_OF.get(asked[-1].lower())
    return language(prompt, 1, 1.3)


def defect(prompt: str | None, response: str | None, cut: bool) -> str | None:
    """The defect of a pair, or None. A withheld response is none; a withheld or null prompt leaves out copy and language."""
    if response == WITHHELD:
        return None
    if is_empty(response):
        return "empty"
    if cut:
        return "truncated"
    if is_refusal(response):
        return "refusal"
    if prompt is None or prompt == WITHHELD:
        return None
    if is_copy(prompt, response):
        return "copy"
    if not response.lstrip().startswith(("{", "|")):
        spoken = language(response)
        if spoken is not None:
            wanted = wanted_language(prompt)
            if wanted is not None and wanted != spoken and not asks_to_repeat(prompt, prompt.lower().split()):
                return "language"
    return None


def with_defects(calls: DataFrame) -> DataFrame:
    """(call_id, source, defect) of each call once; defect is null for a sound pair.

    Texts are read three times (statistics, limits, verdicts) and never shuffled. Rows
    without a call_id take part in the statistics only. Nulls in any other column are fine.
    """
    calls = calls.select("call_id", "source", "prompt", "response")
    limits, words = evidence(calls)
    shared = calls.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shared.value
        for batch in batches:
            found, asked = [], []
            for source, prompt, response in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                item = Asked()
                cut = is_cut(response, at_limit(response, limits.get((source or "", "response"))), item, prompt)
                found.append(defect(prompt, response, cut))
                asked.append(None if found[-1] == "empty" else item.word)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(asked, pa.string())], names=["call_id", "source", "defect", "word"])

    verdicts = calls.mapInArrow(run, "call_id bigint, source string, defect string, word string")
    verdicts = write_once(verdicts.filter("call_id is not null").dropDuplicates(["call_id"]))
    late = unknown_items(verdicts.select("call_id", F.lit("response").alias("field"), "word"), words)
    return verdicts.join(late, "call_id", "left").select("call_id", "source", F.when(F.col("field").isNotNull(), "truncated").otherwise(F.col("defect")).alias("defect"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, defect) of the calls with a defect."""
    return with_defects(llm_calls(spark, sf_dir)).filter("defect is not null").select("call_id", "defect")


def p1_defects_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per source and defect, sound pairs included."""
    return with_defects(llm_calls(spark, sf_dir)).groupBy("source", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("calls"))


QUERIES = {"p1_found": p1_found, "p1_defects_by_source": p1_defects_by_source}
