"""Prompt and response pairs whose response fails to answer: empty, copied, refusal, truncated, other_language.

Method: truncation is found by a pushdown parser over fences, code, emphasis, brackets, quotations, tags, table rows,
list items and the answer line, whose stack must be empty and whose last state must be an end; copies by greedy
string tiling of the response with the question; the other language by scripts and a model of letter groups, trained
here; refusals by a small grammar of declining clauses, that counts only where no answer stands beside it. The order
of the list above decides where several hold. Stored status fields are not looked at.

The last item of a list ends like the items before it: without a full stop where these have none. An item that stops
after a word or sign that nothing can end with is cut off in any list.

A null question has no language and cannot be copied. Very long texts are parsed in one pass. Repeated rows give
one result; of several different responses to one request the first kind in the order above is reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import spread

DEFECTS = ["empty", "copied", "refusal", "truncated", "other_language"]

#: Responses that stand for none (fixed values), as they remain after markup and labels are removed.
PLACEHOLDERS = {"", "null", "none", "nil", "nan", "na", "n a", "tbd", "tba", "todo", "undefined", "answer", "response", "placeholder", "no answer", "empty", "blank", "pending", "lorem ipsum"}
#: Values of an answer line that give no answer (fixed values).
NO_VALUES = {"insufficient", "n/a", "na", "unknown", "not available", "none", "unavailable", "not found", "not given", "not disclosed", "unanswerable", "cannot answer", "null", ""}
#: Words that neither a sentence nor a list item ends with (fixed values).
NO_END = {
    "the", "a", "an", "of", "and", "or", "to", "in", "for", "with", "by", "from", "which", "at", "on", "is", "are", "was", "were", "than", "as", "its", "their", "that", "between",
    "der", "die", "das", "und", "oder", "den", "dem", "des", "mit", "von", "für", "zu", "im", "am", "auf", "bei", "ein", "eine", "einen",
    "le", "la", "les", "du", "un", "une", "et", "ou", "dans", "pour", "par", "sur", "aux", "avec", "de",
    "el", "los", "las", "del", "y", "o", "con", "para", "que", "una", "os", "um", "uma", "do", "da", "dos", "das", "em", "no", "na", "и", "в", "на", "с", "по", "для",
}
#: Plain business prose, from which the letter groups of each language are learnt.
PROSE = {
    "en": "They reported that its revenue was higher than in the year before, because of strong demand and new customers. What was the total amount of interest expense at the end of the fiscal year? According to the filing, net income came to several million and this is the figure which they gave. How much did the costs change between these years, and by how many percent? We have not been able to find it there. Management attributes the movement to lower prices, which were partly offset by other effects. It does not say when the agreement would end or who has approved it. Please compare both amounts from the table with each other. Yes, this is from the annual report; after that there had been no further charges.",
    "de": "Das Unternehmen berichtete, dass die Erlöse im Geschäftsjahr höher waren als im Jahr davor, weil die Nachfrage stark gestiegen ist. Wie hoch war der Zinsaufwand am Ende des Jahres und welche Rückstellungen wurden gebildet? Laut dem Bericht beträgt der Gewinn mehrere Millionen, und diese Zahl ergibt sich aus der Tabelle. Der Vorstand führt die Entwicklung auf niedrigere Preise zurück, die zum Teil durch andere Wirkungen ausgeglichen wurden. Nach den Angaben der Gesellschaft sind keine weiteren Kosten angefallen, auch nicht für die Mitarbeiter. Um wie viel Prozent hat sich der Umsatz zwischen den beiden Jahren verändert? Es wird nicht gesagt, wann der Vertrag endet oder wer ihn genehmigt hat.",
    "fr": "La société a indiqué que son chiffre d’affaires était plus élevé que l’année précédente, grâce à une forte demande et à de nouveaux clients. À combien s’élevaient les charges d’intérêts à la fin de l’exercice ? Selon le rapport, le résultat net a atteint plusieurs millions et c’est le montant qui figure dans le tableau. La direction explique cette évolution par la baisse des prix, compensée en partie par d’autres effets. De combien de pour cent les coûts ont-ils changé entre ces deux années ? Il n’est pas dit quand le contrat prend fin ni qui l’a approuvé. Aucune autre dépense n’a été constatée pour les salariés au cours de cette période.",
    "es": "La compañía informó que sus ingresos fueron mayores que en el año anterior, debido a una fuerte demanda y a nuevos clientes. ¿Cuál fue el importe total de los gastos por intereses al cierre del ejercicio? Según el informe, el beneficio neto alcanzó varios millones y esta es la cifra que aparece en la tabla. La dirección explica el cambio por los precios más bajos, que se compensaron en parte con otros efectos. ¿En qué porcentaje cambiaron los costes entre estos dos años y cuántos empleados tenía? No se dice cuándo termina el contrato ni quién lo ha aprobado. No hubo otras pérdidas para los trabajadores durante el período.",
    "pt": "A empresa informou que as suas receitas foram maiores do que no ano anterior, devido a uma forte procura e a novos clientes. Qual foi o valor total das despesas com juros no final do exercício? Segundo o relatório, o lucro líquido atingiu vários milhões e este é o número que aparece na tabela. A direção explica a mudança pelos preços mais baixos, que foram em parte compensados por outros efeitos. Em quantos por cento mudaram os custos entre estes dois anos e quantos empregados tinha? Não se diz quando termina o contrato nem quem o aprovou. Não houve outras perdas para os trabalhadores durante o período; também não há informações sobre isso.",
    "it": "La società ha comunicato che i suoi ricavi sono stati più alti rispetto all’anno precedente, grazie a una forte domanda e a nuovi clienti. Qual è stato l’importo totale degli oneri finanziari alla fine dell’esercizio? Secondo la relazione, l’utile netto ha raggiunto diversi milioni e questa è la cifra che si trova nella tabella. La direzione spiega il cambiamento con i prezzi più bassi, compensati in parte da altri effetti. Di quanto sono cambiati i costi tra questi due anni e quanti dipendenti aveva? Non viene detto quando finisce il contratto né chi lo ha approvato. Non ci sono state altre perdite per i lavoratori nel corso del periodo.",
    "nl": "Het bedrijf meldde dat de omzet hoger was dan in het jaar daarvoor, omdat de vraag sterk is gestegen en er nieuwe klanten zijn gekomen. Hoe hoog waren de rentelasten aan het einde van het boekjaar? Volgens het verslag bedroeg de nettowinst enkele miljoenen en dit is het cijfer dat in de tabel staat. De directie verklaart de ontwikkeling door lagere prijzen, die voor een deel werden gecompenseerd door andere effecten. Met hoeveel procent zijn de kosten tussen deze twee jaren veranderd? Er wordt niet gezegd wanneer de overeenkomst eindigt of wie deze heeft goedgekeurd. Er waren geen andere verliezen voor de werknemers.",
    "pl": "Spółka poinformowała, że jej przychody były wyższe niż w poprzednim roku, ponieważ popyt wzrósł i pojawili się nowi klienci. Jaka była łączna kwota kosztów odsetek na koniec roku obrotowego? Według sprawozdania zysk netto wyniósł kilka milionów i jest to liczba, która znajduje się w tabeli. Zarząd tłumaczy tę zmianę niższymi cenami, częściowo wyrównanymi przez inne skutki. O ile procent zmieniły się koszty między tymi latami? Nie podano, kiedy umowa się kończy ani kto ją zatwierdził.",
    "sv": "Bolaget rapporterade att intäkterna var högre än året innan, eftersom efterfrågan har ökat och nya kunder har tillkommit. Hur stora var räntekostnaderna i slutet av räkenskapsåret? Enligt rapporten uppgick nettoresultatet till flera miljoner och detta är den siffra som finns i tabellen. Ledningen förklarar utvecklingen med lägre priser, som delvis uppvägdes av andra effekter. Med hur många procent har kostnaderna förändrats mellan dessa år? Det sägs inte när avtalet upphör eller vem som har godkänt det.",
}
#: Letter groups learnt: their lengths; the count that each is given beforehand; and the nats by which a language must lead.
GROUPS, BEFORE, LEAD = (1, 2, 3, 4), 0.4, 8.0
#: Weight of a word that the prose lacks: many are names.
STRANGE = 0.3
_SCRIPTS = {"ru": re.compile("[Ѐ-ӿ]"), "el": re.compile("[Ͱ-Ͽ]"), "zh": re.compile("[぀-ヿ一-鿿]"), "ar": re.compile("[؀-ۿ]"), "hi": re.compile("[ऀ-ॿ]")}
#: Labels before a copy or an answer.
_LABEL = re.compile(r"^\W*(?:(?:final\s+)?answer|response|question|q|a|you asked|here is the question again|the question (?:was|is)|prompt|antwort|frage|réponse|question posée|respuesta|pregunta)\s*:\s*", re.I)
_ANSWER_LINE = re.compile(r"(?im)^[ \t>*_#-]*(?:final\s+)?answer[*_ \t]*:[ \t]*(.*)$")
_WORD = re.compile(r"\w+(?:[.,]\d+)*")
_INVISIBLE = re.compile("[​-‏⁠﻿­‪-‮]")
_FIGURE = re.compile(r"[$€£%]|\d[\d .,]*\s*(?:%|million|billion|thousand|mio|mrd|millions?|millones|milh)|\d[\d,]*\.\d|\d{1,3}(?:[, ]\d{3})+", re.I)

#: The grammar of declining clauses: who lacks, a negation or lack, and what is lacking.
_SOURCE = r"(?:evidence|excerpts?|passages?|chunks?|sections?|documents?|filings?|sources?|materials?|context|information|text|data|provided|retrieved|supplied)"
_REFUSALS = [
    rf"\b{_SOURCE}\b[^.]*\b(?:does|do|did) not (?:contain|include|state|give|mention|disclose|provide|show|report|cover|say|speak)",
    rf"\b(?:none of|no|neither|not enough)\b[^.]*\b{_SOURCE}\b",
    rf"\b{_SOURCE}\b[^.]*\b(?:silent|no basis|leaves?\b[^.]*\bopen|only covers?|lacks?|missing)\b",
    r"\b(?:can(?:not|['’]t| not)|could(?: not|n['’]t)|unable to|not able to|(?:is|was|be) (?:not|n['’]t) possible|isn['’]t possible|won['’]t|will not|must decline|decline to|rather not|refuse to|no way (?:to|of)|not in a position)\b",
    r"\bno (?:answer|figure|statement|conclusion)\b[^.]*\b(?:possible|available|found|given)\b",
    r"\b(?:i |we )?(?:do not|don['’]t) know\b|\bnowhere (?:disclosed|stated|given|found|mentioned|to be found)\b|\b(?:not|never) (?:disclosed|stated|available|mentioned|answerable|determinable|provided|given|known)\b|\bfalls outside\b|\bunanswerable\b|\bremains? (?:unknown|open|unclear)\b|\bi have no\b",
    r"\b(?:leider|bedauerlicherweise)\b|\bnicht (?:beantworten|möglich|ermitteln|enthalten|bestimmen|angeben)\b|\bkeine (?:angaben|informationen|antwort|auskunft)\b|\bkann ich nicht\b",
    r"\bje (?:regrette|ne peux)\b|\bne (?:permettent|permet|contiennent|contient|peux|peut|figure)\b[^.]*\bpas\b|\bimpossible de\b|\babsente?s? d|\bdésolé",
    r"\blo siento\b|\bno (?:puedo|contienen?|es posible|se puede|figura|permiten?|hay (?:datos|información))\b",
    r"\b(?:lamento|desculpe|infelizmente)\b|\bnão (?:posso|contêm|é possível|consta|há (?:dados|informaç))",
    r"\b(?:извините|к сожалению)\b|не (?:могу|содерж|позволя|удалось)",
]
_REFUSAL = re.compile("|".join(_REFUSALS), re.I)

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»"}
_CLOSE = set(")]}”»")
_END = set(".!?…。！？")
#: Abbreviations that cannot end a sentence (fixed values).
_UNFINISHED = re.compile(r"(?:\b(?:Mio|Mrd|approx|vs|e\.g|i\.e|No|Dr|Mr|Mrs|cf|bzw|ca|z\.B|incl|excl)|[$€£]\s?)\.$")
_VALUE = re.compile(r"^[-+(]?[$€£]?\s?\d[\d .,’']*(?:[.,]\d+)?\)?\s?%?\s?(?:(?:million|billion|thousand|millions?|millones|Mio|Mrd)\b\.?)?\s?(?:[$€£]|USD|EUR|euros?|d’euros)?$|^(?:yes|no|true|false|ja|nein|oui|non|sí|si|sim|não|да|нет)$", re.I)


def bare(text: str) -> str:
    """The text without markup, labels and punctuation, in lower case."""
    text = _INVISIBLE.sub("", text)
    while (cut := _LABEL.sub("", text)) != text:
        text = cut
    return re.sub(r"[\W_]+", " ", text).strip().lower()


def is_empty(answer: str | None) -> bool:
    return answer is None or bare(answer) in PLACEHOLDERS


def _free_runs(taken: list[bool]) -> list[int]:
    """How many words from each place on are not taken."""
    runs = [0] * (len(taken) + 1)
    for i in range(len(taken) - 1, -1, -1):
        runs[i] = 0 if taken[i] else runs[i + 1] + 1
    return runs


def _tile(a: list[str], q: list[str], taken: list[bool], used: list[bool], least: int) -> None:
    """Marks the tiles of two word lists: the longest common runs of free words first, each word in one tile."""
    mod, base = (1 << 61) - 1, 0x1F3D5B79
    sums = []
    for words in (a, q):
        s = [0]
        for w in words:
            s.append((s[-1] * base + hash(w)) % mod)
        sums.append(s)
    power = [1]
    for _ in range(min(len(a), len(q))):
        power.append(power[-1] * base % mod)

    def places(k: int, runs: list[int], n: int) -> Iterator[tuple[int, int]]:
        s, p = sums[k], power[n]
        return (((s[i + n] - s[i] * p) % mod, i) for i in range(len(runs) - n) if runs[i] >= n)

    high = min(len(a), len(q))
    while high >= least:
        free_a, free_q = _free_runs(taken), _free_runs(used)
        low, top = least - 1, min(high, max(free_a, default=0), max(free_q, default=0))
        while low < top:  # the longest run that both have left
            n = (low + top + 1) // 2
            keys = {k for k, _ in places(1, free_q, n)}
            low, top = (n, top) if any(k in keys for k, _ in places(0, free_a, n)) else (low, n - 1)
        if low < least:
            return
        where: dict[int, list[int]] = {}
        for k, j in places(1, free_q, low):
            where.setdefault(k, []).append(j)
        ends_a = ends_q = -1
        for k, i in places(0, free_a, low):
            if i < ends_a or k not in where:
                continue
            while where[k]:
                j = where[k].pop(0)
                if not any(used[j : j + low]) and a[i : i + low] == q[j : j + low]:
                    taken[i : i + low] = used[j : j + low] = [True] * low
                    ends_a, ends_q = i + low, j + low
                    break
        high = low - (ends_q < 0)


def tiling(answer: list[str], question: list[str], least: int = 2) -> tuple[float, float]:
    """Shares of the answer's and of the question's words in the tiles of a greedy string tiling. An answer that says
    the question again is tiled with it again, by runs of at least half of the question."""
    taken, used = [False] * len(answer), [False] * len(question)
    least = min(least, max(1, len(question)))
    _tile(answer, question, taken, used, least)
    again, before = max(least, (len(question) + 1) // 2), -1
    while len(answer) - sum(taken) >= again and sum(taken) > before:
        before = sum(taken)
        _tile(answer, question, taken, [False] * len(question), again)
    return sum(taken) / max(1, len(answer)), sum(used) / max(1, len(question))


def is_copy(answer: str, question: str | None) -> bool:
    if not question:
        return False
    q = _WORD.findall(question.lower())
    lines = [_LABEL.sub("", x) for x in answer.split("\n")]
    a = _WORD.findall("\n".join(_LABEL.sub("", x) for x in lines).lower())
    if len(a) > 3 * len(q) + 8 or not a:
        return False
    own = set(q)
    if sum(n for w, n in Counter(a).items() if w in own) < 0.8 * len(a):
        return False  # words that the question lacks are in no tile
    of_answer, of_question = tiling(a, q)
    return of_answer >= 0.8 and of_question >= 0.5 and len(a) >= min(3, len(q))


def gives_value(answer: str) -> bool:
    """Whether an answer line holds a value, or a figure stands anywhere."""
    for value in _ANSWER_LINE.findall(answer):
        v = value.strip(" \t*_`").lower()
        if v.rstrip(".") not in NO_VALUES:
            return True
    return bool(_FIGURE.search(_ANSWER_LINE.sub("", answer)))


def is_refusal(answer: str) -> bool:
    if gives_value(answer):
        return False
    values = [v.strip(" \t*_`.").lower() for v in _ANSWER_LINE.findall(answer)]
    prose = _ANSWER_LINE.sub("", answer)
    return bool(_REFUSAL.search(prose)) or (bool(values) and all(v in NO_VALUES - {""} for v in values) and not _FIGURE.search(prose))


_MARK = re.compile(r"```|\*\*|`|<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>|[\"()\[\]{}“”„«»]")
_ITEM = re.compile(r"^\s*(?:[-*•+–]|\(?\d{1,3}[.)]|\(?[a-z][.)])(?:\s+|$)(.*)$")
#: Tags that need no end (fixed values).
_OPTIONAL = {"br", "hr", "img", "input", "meta", "link", "wbr", "p", "li", "td", "th", "tr", "dt", "dd", "option"}


def _open_marks(text: str) -> list[str]:
    """The stack of a pushdown parse of fences, code, emphasis, tags, quotations and brackets at the end of the text."""
    stack: list[str] = []

    def toggle(mark: str) -> None:
        if mark in stack:
            while stack.pop() != mark:
                pass
        else:
            stack.append(mark)

    for m in _MARK.finditer(text):
        c = m.group()
        if stack and stack[-1] in ("```", "`"):
            if c == stack[-1]:
                stack.pop()
        elif m.group(2):
            name = "<" + m.group(2).lower()
            if m.group(1):
                if name in stack:
                    while stack.pop() != name:
                        pass
            elif not m.group(3) and name[1:] not in _OPTIONAL:
                stack.append(name)
        elif c in ("```", "**", "`"):
            toggle(c)
        elif c == '"':
            # after a figure, with no quotation open, it means inches or seconds
            if '"' in stack or not (m.start() and text[m.start() - 1].isdigit()):
                toggle(c)
        elif stack and c in _OPEN.get(stack[-1], ""):
            stack.pop()
        elif c in _OPEN:
            stack.append(c)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if c in _OPEN.get(stack[k], ""):
                    del stack[k:]
                    break
    return stack


def _stops_short(end: str) -> bool:
    """Whether a piece of text stops at a word or sign that nothing ends with."""
    last = re.search(r"[^\W\d_]+$", end)
    return not end or end[-1] in ",;:$€£(-–—/&+=<" or bool(_UNFINISHED.search(end)) or bool(last and last.group().lower() in NO_END)


def _list_goes_on(lines: list[str], end: str) -> bool:
    """Whether the last line, a list item, is cut off: the items before it tell whether one ends with a full stop."""
    if _stops_short(end):
        return True
    if end[-1] in _END:
        return False
    before = []
    for line in reversed(lines[:-1]):
        if (m := _ITEM.match(line)) is not None:
            before.append(_bare_end(m.group(1)))
        elif line.strip() and not line[0].isspace():
            break
    return not any(x and x[-1] not in _END for x in before)


def _bare_end(text: str) -> str:
    return text.rstrip("\"”»“')]}*_`’ ")


def is_truncated(answer: str) -> bool:
    """Pushdown parse of the whole answer."""
    text = _INVISIBLE.sub("", answer).rstrip()
    if _open_marks(text) or re.search(r"</?[A-Za-z][^<>\n]{0,200}$", text):
        return True
    lines = text.split("\n")
    last = lines[-1].strip()
    if last.startswith("```"):
        return False
    if (m := _ANSWER_LINE.match(last)) is not None:
        value = m.group(1).strip(" \t*_`")
        return not value or value[-1] in ",:;$€£(-–—/" or bool(_UNFINISHED.search(value))
    if last.startswith("|"):
        return not last.endswith("|") or last.count("|") < 3 or not last.strip("| ") or _fewer_cells(text)
    end = _bare_end(re.sub(r"(?:</[A-Za-z]+>\s*)+$", "", last))
    if _VALUE.match(end.rstrip(".")) and not end.endswith((",", "-")):
        return False
    if (m := _ITEM.match(lines[-1])) is not None:
        return _list_goes_on(lines, _bare_end(re.sub(r"(?:</[A-Za-z]+>\s*)+$", "", m.group(1))))
    return not end or end[-1] not in _END or bool(_UNFINISHED.search(end))


def _fewer_cells(text: str) -> bool:
    rows = [x.strip() for x in text.split("\n") if x.strip().startswith("|")]
    return rows[-1].count("|") < rows[0].count("|")


class Languages:
    """Log likelihood of words by the groups of letters of each language, learnt from PROSE."""

    def __init__(self, prose: dict[str, str]):
        self.names = list(prose)
        counts = [Counter(g for w in _letters(text) for g in self.groups(w)) for text in prose.values()]
        known = set().union(*counts)
        per = {n: [sum(c for g, c in own.items() if len(g) == n) for own in counts] for n in {len(g) for g in known}}
        kinds = Counter(len(g) for g in known)
        self.gain = {g: np.array([math.log((own[g] + BEFORE) / (per[len(g)][k] + BEFORE * kinds[len(g)])) for k, own in enumerate(counts)]) for g in known}
        for v in self.gain.values():
            v -= v.mean()
        self.usual, self.words = {w for text in prose.values() for w in _letters(text)}, {}
        self.rows = np.zeros((1024, len(self.names)))

    @staticmethod
    def groups(word: str) -> list[str]:
        w = f"_{word}_"
        return [w[i : i + n] for n in GROUPS for i in range(len(w) - n + 1) if n > 1 or w[i] != "_"] + ([w] if len(w) > max(GROUPS) else [])

    def scores(self, words: list[str]) -> np.ndarray:
        """Nats by which each language is likelier than the average, over the words; groups overlap, so they count in part."""
        if len(self.words) + len(words) > 1 << 18:
            self.words.clear()
        at = []
        for w in words:
            if (k := self.words.get(w)) is None:
                k = self.words[w] = len(self.words)
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                own = [v for g in self.groups(w) if (v := self.gain.get(g)) is not None]
                self.rows[k] = np.clip(np.sum(own, axis=0) / len(GROUPS), -4, 4) * (1.0 if w in self.usual else STRANGE) if own else 0.0
            at.append(k)
        return self.rows[at].sum(axis=0)


@cache
def languages() -> Languages:
    return Languages(PROSE)


def _letters(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


def script(text: str) -> str | None:
    if text.isascii():
        return None
    letters = sum(c.isalpha() for c in text)
    return next((name for name, own in _SCRIPTS.items() if letters and len(own.findall(text)) > 0.4 * letters), None)


def language(text: str, default: str | None = None) -> str | None:
    """Language by script, else by letter groups; the default where no language leads it clearly."""
    if (own := script(text)) is not None:
        return own
    known = languages()
    score = known.scores(_letters(text))
    best = int(score.argmax())
    other = known.names.index(default) if default in known.names else int(np.argsort(score)[-2])
    return known.names[best] if best != other and score[best] - score[other] >= LEAD else default


def is_other_language(answer: str, question: str | None, default: str = "en") -> bool:
    """Whether the answer, without quotations and answer lines, is in another language than the question."""
    if not question:
        return False
    asked = language(question, default)
    said = re.sub(r"</?[A-Za-z][^<>]*>|„[^“”]*[“”]|“[^”]*”|«[^»]*»|\"[^\"]*\"", " ", _ANSWER_LINE.sub("", answer))
    return language(said, asked) != asked


def defect(question: str | None, answer: str | None) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_copy(answer, question):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    return "other_language" if is_other_language(answer, question) else None


def defects(pairs: DataFrame, key: str = "request_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, defect) of each defective request. Texts are not shuffled: repeated pairs are judged
    where they lie, and their equal results merged by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            at = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array([DEFECTS.index(found[i]) for i in at], pa.int32())], names=[key, "at"])

    kind = pairs.schema[key].dataType.simpleString()
    judged = spread(pairs.select(key, question, answer)).mapInArrow(run, f"`{key}` {kind}, at int")
    names = F.array(*map(F.lit, DEFECTS))
    return judged.groupBy(key).agg(F.min("at").alias("at")).select(key, F.element_at(names, F.col("at") + 1).alias("defect"))
