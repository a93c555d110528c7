"""Abusive, hateful or sexual content (problem 10).

Noisy channel: disguised spans (digits and signs for letters, masked letters, letters apart,
drawn-out letters, look-alike and invisible characters) are decoded by a Viterbi search
over their character lattice under a character language model; words one slip of a finger
away from a word of the lexicon are restored where the model finds that word much likelier.
The model's counts come from the words of all documents; its table is bounded by the
alphabet, not by the corpus.

The restored text is scored sentence by sentence. Words fall into classes (``lexicon``: who is
spoken of, insults, animals, violence, groups of people, sexual words ...) and a grammar over
the sequence of classes says what makes a case: an insult said of a person, a threat, a group
with what degrades or excludes it. Findings add up within a sentence; a document's score for
a category is that of its worst sentence, and it is a case from 1.0.

Defined results
    * null and blank texts score 0 in every category.
    * whole texts are read, whatever their length; repeated documents are scored each.
    * an empty corpus gives the language model of the lexicon alone.
    * extra columns are ignored; null sources count as '' in the rates.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almudi.llm import lexicon as X

CATEGORIES = ("abusive", "hateful", "sexual")
THRESHOLD = 1.0
ORDER = 4
PRIOR = 40
SLIP = 4.0

# Look-alike letters, and signs that stand for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i"}
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "2": "z", "6": "g"}
MASKS = "*#_"

_INVISIBLE = [chr(c) for c in (*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD, *range(0x202A, 0x202F))]
_ACCENTS = dict(zip("áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc", strict=True))
_NORMAL = str.maketrans(LOOKALIKES | _ACCENTS | dict.fromkeys(_INVISIBLE, ""))
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+|<br ?/?>|\n")
_NUMBER = re.compile(r"(?<![\w#*@$|+€.,-])\d+(?:[.,]\d+)*(?=[\s;:)?!]|[.,](?:\s|$)|$)")
_TOKEN = re.compile(r"[a-z0-9]+|[,;:()]")
_APART = re.compile(r"(?<![a-z0-9])[a-z0-9]([ .\-_*])(?:[a-z0-9]\1)+[a-z0-9](?![a-z0-9])")
_MIXED = re.compile(r"(?<![a-z0-9#*_@$|+€])(?=[a-z0-9#*_@$|+€!]*[a-z])(?=[a-z0-9#*_@$|+€!]*[0-9#*_@$|+€!][a-z0-9]*)[a-z0-9#*_@$|+€][a-z0-9#*_@$|+€!]*[a-z0-9#*_@$|+€]")
_DRAWN = re.compile(r"(?<![a-z])(?=[a-z]*([a-z])\1\1)(?!x+(?![a-z]))[a-z]{4,}(?![a-z])")
_PLAIN_MIX = re.compile(r"\d+(?:x\d+)+[a-z]*|\d+(?:[a-z]{1,3}|gramos|mililitros|libras|onzas|unid|unidades|piezas|litros|kilos?)|[0-9a-f]{6}|[a-z]\d+|\d+%?")
_SUSPECT = re.compile(r"[a-z][0-9#*_@$|+€!]|[0-9#*_@$|+€][a-z]|([a-z])\1\1|[a-z0-9]([ .\-_*])[a-z0-9]\2[a-z0-9](?![a-z0-9])")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A word without plural and gender, as far as four letters stay."""
    if len(word) > 3 and word.endswith("s"):
        word = word[:-1]
    return word[:-1] if len(word) > 4 and word[-1] in "aeo" else word


def _stems(words) -> frozenset[str]:
    return frozenset(stem(w) for w in words)


_SEXUAL = {stem(w): (weight, stem(w)) for weight, words in sorted(X.SEXUAL.items()) for w in words}
#: Words that are restored from slips and sequences written without blanks.
WORDS = frozenset(w for c in (X.INSULT, X.WEAK, X.BEAST, X.SWEAR, X.PERSON, X.GROUPS, X.SLURS, X.DEGRADING, X.EXCLUDING, X.SELF_HARM, X.LEAVE, X.COLLECTIVE, *X.SEXUAL.values()) for w in c) | {"religion", "sexuales", "oral", "piece", "pedazo", "humana", "gente"}
_WORD_STEMS = frozenset(map(stem, WORDS))


def _cuts(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


_BY_CUT: dict[str, set[str]] = {}
for _w in WORDS - set(X.BEAST) - set(X.PERSON) | {"animal"}:  # names of animals and jobs lie too near to other words
    if len(_w) > 4:
        for _c in _cuts(_w) | {_w}:
            _BY_CUT.setdefault(_c, set()).add(_w)


@lru_cache(maxsize=20_000)
def unjoined(text: str) -> str | None:
    """Letters written without blanks as words of the lexicon, or None."""
    best: list[str | None] = [""] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if best[start] is not None and (piece in X.SMALL or (len(piece) > 2 and (piece in WORDS or stem(piece) in _WORD_STEMS))):
                found = f"{best[start]} {piece}".strip()
                if best[end] is None or found.count(" ") < best[end].count(" "):
                    best[end] = found
    return best[-1]


class CharModel:
    """Letter n-gram counts with stupid back-off; '^' starts a word, '$' ends it.

    The lexicon's words are added with a fixed weight, so that they are no rarer than
    the words of a corpus without them.
    """

    def __init__(self, counts: dict[str, int]):
        counts = dict(counts)
        for word in WORDS:
            w = f"^{word}$"
            for k in range(1, ORDER + 1):
                for i in range(len(w) - k + 1):
                    counts[w[i : i + k]] = counts.get(w[i : i + k], 0) + PRIOR
        self.counts = counts
        self.context: dict[str, int] = {}
        for gram, n in counts.items():
            self.context[gram[:-1]] = self.context.get(gram[:-1], 0) + n

    @lru_cache(maxsize=500_000)  # noqa: B019 - one model per worker
    def logp(self, context: str, c: str) -> float:
        back = 0.0
        while True:
            total = self.context.get(context, 0)
            if total and (n := self.counts.get(context + c, 0)):
                return back + math.log(n / total)
            if not context:
                return back + math.log(1e-4)
            context, back = context[1:], back + math.log(0.4)


def emissions(span: str, i: int) -> list[tuple[str, float]]:
    """What the character at ``i`` may stand for, with its log-probability."""
    c = span[i]
    if "a" <= c <= "z":
        drawn = i > 0 and span[i - 1] == c
        longer = drawn and ((i > 1 and span[i - 2] == c) or (i + 1 < len(span) and span[i + 1] == c))
        return [(c, -2.0 if longer else 0.0), ("", -0.1 if longer else -5.0)] if drawn else [(c, 0.0)]
    if c in MASKS:
        return [(x, -1.6) for x in "aeiou"] + [(x, -4.0) for x in "bcdfghjklmnpqrstvwxyz"]
    if c in SIGNS:
        return [(x, -0.3) for x in SIGNS[c]]
    return [("", 0.0)]


def decode(span: str, model: CharModel) -> str:
    """The likeliest letters behind a disguised span: Viterbi over its lattice, with the
    last letters as state."""
    states: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    for i in range(len(span)):
        options = emissions(span, i)
        nxt: dict[str, tuple[float, str]] = {}
        for state, (p, out) in states.items():
            for c, q in options:
                score, key = (p + q + (model.logp(state, c) if c else 0.0)), (state + c)[-(ORDER - 1) :]
                if key not in nxt or score > nxt[key][0]:
                    nxt[key] = (score, out + c)
        states = nxt
    return max(((p + model.logp(s, "$"), out) for s, (p, out) in states.items()), default=(0.0, ""))[1]


def normal(text: str) -> str:
    return text.lower() if text.isascii() else text.lower().translate(_NORMAL)


class Restorer:
    def __init__(self, model: CharModel):
        self._model = model
        self._decode = lru_cache(maxsize=100_000)(lambda s: decode(s, model))
        self.slip = lru_cache(maxsize=200_000)(self._slip)

    def _logp(self, word: str) -> float:
        w, p = f"^{word}$", 0.0
        for i in range(1, len(w)):
            p += self._model.logp(w[max(0, i - ORDER + 1) : i], w[i])
        return p

    def _slip(self, word: str) -> str:
        """The lexicon's word that ``word`` is one dropped, doubled or swapped letter away
        from, where the model finds it likelier by more than a slip costs."""
        if len(word) < 5 or word in WORDS or stem(word) in _WORD_STEMS or not word.isalpha():
            return word
        near = {w for c in _cuts(word) | {word} for w in _BY_CUT.get(c, ()) if abs(len(w) - len(word)) == 1 or sorted(w) == sorted(word)}
        best = max(sorted(near), key=self._logp, default=word)
        return best if best != word and self._logp(best) - SLIP > self._logp(word) else word

    def _apart(self, m: re.Match) -> str:
        """Letters apart, joined; a word of one letter before or after isn't part of them."""
        whole = self._decode(m[0].replace(m[1], ""))
        for head, tail in ((0, 0), (1, 0), (0, 1), (1, 1)):
            if (words := unjoined(whole[head : len(whole) - tail])) is not None:
                return f"{whole[:head]} {words} {whole[len(whole) - tail :]}".strip()
        return whole

    def restore(self, text: str) -> str:
        """Normal letters for everything disguised in ``text`` (already ``normal``)."""
        if not _SUSPECT.search(text):
            return text
        text = _APART.sub(self._apart, text)
        text = _MIXED.sub(lambda m: m[0] if _PLAIN_MIX.fullmatch(m[0]) else self._decode(m[0]), text)
        return _DRAWN.sub(lambda m: self._decode(m[0]), text)

    def words(self, sentence: str) -> list[str]:
        """The restored words of a ``normal`` sentence, commas kept."""
        out = []
        for w in _TOKEN.findall(self.restore(sentence).replace("'", "").replace("\u2019", "")):
            joined = unjoined(w) if len(w) > 7 and stem(w) not in _WORD_STEMS else None
            out += joined.split() if joined else [w if not w[0].isalnum() else self.slip(w)]
        return [w if w[0].isalnum() else "," for w in out]


# ---- grammar ---------------------------------------------------------------------------
_BOUND = "(?<![a-z0-9])(?:{})(?![a-z0-9])"


def _phrases(rules: dict[float, list[str]]) -> list[tuple[re.Pattern, float]]:
    return [(re.compile(_BOUND.format(r)), w) for w, rs in rules.items() for r in rs]


#: Phrases that become one word before classes are looked up.
_UNITED = [
    (re.compile(_BOUND.format(p)), w)
    for p, w in [
        ("hij[oa]s? de (?:la gran |su )?(?:puta|perra|madre)|sons? of a (?:bitch|whore)|mal parid[oa]s?", "hijueputa"),
        ("pieces? of (?:shit|garbage|trash|crap)|pedazos? de (?:mierda|basura|animal|porqueria|escoria)", "escoria"),
        ("(?:basura|escoria|desecho|mierda|rata)s? (?:human[oa]s?|de (?:persona|gente|ser))|human (?:garbage|trash|waste|scum)", "gentuza"),
        ("buen[oa]s? para nada|good for nothing|waste of (?:space|oxygen|air)", "inutil"),
        ("(?:el|la|los) del? (?:la )?(?:mostrador|caja|sucursal|pasillo|entrada|ventanilla)", "cajero"), ("|".join(X.GROUP_PHRASES), "extranjeros"), ("no one", "nobody"), ("nothing but", "just"),
    ]
]

_LIVE = "|".join(X.LIVE)
_AGENT = "dio|dieron|escribi[oa]\\w*|puso|atend\\w+|atiende|hizo|vende|invent\\w+|opina|dirige|maneja|cobr\\w+|respond\\w+|contest\\w+|wrote|gave|made|sets?|decides|runs|posted|answers"
_ABUSE_SAID = _phrases({
    1.0: [
        "(?:vete|andate|vayanse|vayase|larga?te|que se vayan?|go|get) (?:a la mierda|al diablo|al carajo|al infierno|a la chingada|to hell|the hell out)", "fuck (?:you|off|u|yourself)|screw you",
        "que te (?:jodan|den|pudras)|chinga tu madre|mama?me la", "(?:no|nunca) (?:vales|servis|sirves|valis)(?: ni)?(?: para)?(?: nada)?", "(?:me |nos )?das (?:asco|lastima|pena|verguenza|risa|grima)", "(?:te|lo|la|los|les) (?:voy|vamos) a \\w+ a (?:palos|golpes|patadas|machetazos|balazos|punetazos|tiros)", "(?:madre|mother|mom) \\w+ (?:\\w+ )?abort\\w+", "(?:que )?asco de (?:persona|gente|hombre|mujer|ser|tipo)", "(?:vas|van|va) a (?:terminar|acabar|amanecer) (?:muert|tirad|enterrad)\\w*", "(?:dar\\w*|doy|damos|demos|den|dan) (?:una|su) (?:buena )?(?:paliza|golpiza|tunda|madriza|verguiza)", "(?:kick|beat|whoop) your ass|beat (?:you|him|her) (?:up|down|to death)", "you (?:disgust me|make me sick)",
        f"(?:se|sabemos|know)(?: exactly)? (?:a )?(?:donde|en donde|where)(?: you| your| tu| tus)?(?: \\w+)?? (?:{_LIVE})", "(?:se|sabemos) (?:a que hora|cuando|por donde) (?:\\w+ )??(?:sales|salis|llegas|pasas|entras)", "(?:te|lo|la|los|las|les) (?:voy|vamos) a (?:dejar|mandar) (?:\\w+ )?en (?:el|un|una) (?:hospital|cementerio|cuneta|ataud)", "(?:te|lo|la|los) van a encontrar (?:muert[oa]s?|tirad[oa]s?|en una? (?:cuneta|zanja|bolsa|rio))",
        "(?:llego|vengo|caigo|llegamos|voy|coming|come) (?:con|with) (?:el|un|una|la|mi|a|my) (?:machete|pistola|escopeta|rifle|bate|gun|shotgun)", "cuid(?:ate|a|ese) (?:la|tu|su) espalda", "watch your back(?= ,| when| if| at| tonight| around| from|$)",
        "(?:tir|bot|ahog|abort)\\w+ al nacer|should have been (?:aborted|drowned)|dropped as a (?:baby|child)", "(?:kill|hang|shoot) yourself|drop dead|pegat?e un tiro|matate|ahorcate|suicidate", "muerete ya|muerete",
    ],
    0.6: [
        "callate|callense|shut (?:the \\w+ )?up|shut your (?:\\w+ )?(?:mouth|trap|face)|cierra (?:la boca|el hocico|el pico)|cerra el pico", "quien (?:te|se) (?:crees|cree|soporta|aguanta|pregunto|pidio|invito)|who asked you|who do you think you are",
        "nadie te \\w+", "ni tu \\w+ te \\w+", "(?:favor al mundo|favor a todos|nos ha(?:ces|rias) un favor|ha[cz]\\w+ un favor a|do (?:us all|us|the world|everyone) a favou?r)", "desaparece(?:te)?(?: para siempre)?|disappear(?: forever)?|die already|quedate encerrad[oa]",
        "no (?:tenes|tienes|tiene) (?:cerebro|verguenza|educacion|madre|neuronas)|no brains?|brain dead", "(?:espero|esperando|esperamos|busco|waiting) .*(?:pistola|machete|rifle|escopeta|bate|gun)", "mereces? (?:ni )?(?:vivir|respirar|nacer|existir)|deserves? (?:to )?(?:live|breathe|exist|die)|ni respirar", "(?:te vas a|te va a|vas a|they will|you will|you ll) (?:arrepentir|pesar|regret|pay|pagar|lamentar)",
        "te (?:voy a )?(?:espero|esperar|buscar|busco|caer) (?:\\w+ ){1,3}?(?:parqueo|parking|salida|afuera|callejon|alley|noche)", "i (?:will|ll|am going to|m gonna|am gonna) (?:find|hunt|get|come for) you(?! (?:a|an|the|some|one|another|cheaper))|coming for you",
        "(?:dejar|mandar|terminar|acabar|put you) (?:\\w+ )?(?:en|in) (?:el|un|una|the|a) (?:hospital|cementerio|cuneta|ditch|grave|cemetery)", "(?:gente|people) (?:como|like) (?:vos|tu|usted|ustedes|you)",
        "(?:even )?your (?:own )?(?:mother|family|kids|mom) (?:is|are) ashamed|nobody (?:would|will) (?:miss|notice|care)",
    ],
    0.5: [f"^(?:que|vaya|menud[oa]) (?:{'|'.join([*X.BEAST, *X.WEAK])}) "],
    0.4: [f"(?:el|la|los|las|quien|guy|one|person|whoever) (?:que|who) (?:{_AGENT})", f"(?:whoever|quien) (?:{_AGENT})", "ni (?:contar|leer|escribir|pensar|hablar|sumar)|can not even \\w+|cant even \\w+", "con (?:cara de|esa cara)", "para que aprendas?|teach you a lesson", f"(?:what kind of|que clase de|que tipo de) (?:\\w+ )+?(?:{_AGENT})", "otra vez (?:vos|tu|usted)", "go (?:and )?cry", "no (?:te )?da(?:s)? verguenza", "contesten de una vez|respondan de una vez"],
})
_ABUSE_TAGS = [(re.compile(r), w) for r, w in [
    ("s", 1.0), ("y[kd]*[wWmi]|yd*k[kd]*.[kd]*[wW]|[wWm]y", 1.0), ("p(?:e.{0,2}?)?d*k[kd]*(?:[wWmi]|.[kd]+[wW]|.[wW])", 1.0), ("pd*[wWi]", 1.0), ("[wWi]p|id?[wWmp]", 1.0), ("oe[wWmi]", 1.0), ("(?:^|,)d*[wWm]ei", 1.0), ("[wWm]ei", 0.7), ("[pyd][wWm].{0,2}z", 1.0),
    ("y[^,]{0,5}W|W[^,]{0,3}y|p[^,]{0,4}W", 0.6), ("W", 0.4), ("k[kd]*W", 0.3),
    ("h(?=.{0,6}[tyu]).{0,8}[xvV]", 1.0), ("t[fd]*vd*[be]", 1.0), ("tf+[de]*[vVx]|tf+d?.d*b", 1.0), ("fd?V", 1.0), ("fd?vd*y", 1.0), ("vyd*b", 1.0), ("V", 0.6), ("n[t][fd]*q", 1.0), ("nf?.?qd?y", 1.0), ("tf+d?.{1,8}g", 0.6), ("eg", 0.4), ("S", 0.5),
    ("m[wWi]|[wWi]m", 0.6), ("(?:^|,)d?[wWmi]+(?:,|$)", 0.5), ("kd*[wmi]", 0.4), ("e[wWmi]", 0.3),
]]

_HATE_SAID = _phrases({
    0.6: [
        "(?:mejor|better)(?: off)? (?:sin|without)", "(?:go|send (?:them|you all|you)|vuelvan|regresen|devuelvan\\w*|larguense|vayanse|se larguen) (?:back|a su (?:pais|tierra)|back to)", "sent back|send \\w+ (?:\\w+ )?back|go back", "no son (?:gente|personas|humanos)|(?:are|is) (?:not|hardly) (?:human|people)",
        "como (?:ratas|animales|cucarachas|conejos)|like (?:rats|animals|vermin|roaches|rabbits)", "huelen? (?:mal|horrible|feo)|smell bad", "throw \\w+ out|kick(?:ed)? (?:\\w+ )?out|thrown out|lock(?:ed)? (?:\\w+ )?up", "(?:que )?pasen hambre|starve|que se mueran|let them die|should (?:just )?die|una bomba|gas them",
        "de nacimiento|por naturaleza|by nature|by blood|by birth|en la sangre|in (?:their|the) blood", "(?:nacieron|nacen) para|(?:are )?born to|belong in|solo sirven para|only good for", "(?:por culpa de|because of|blame)", "where (?:they|you) (?:came|come) from|de donde (?:vinieron|vienen)", "mentally ill|enfermos mentales", "(?:make|makes) me sick|(?:me )?dan? asco", "nobody wants|nadie (?:los|las) quiere",
    ],
    0.4: [
        "(?:dej(?:ar|en|an|emos)(?:los|las|les)?|let) (?:entrar|pasar|in|enter)|allowed|permitir\\w*|v[ei]nd(?:an|er|emos|en)(?:les?)?|atender(?:los|las)?|contrata\\w*|hire|hiring|votar|vote|trust|confiar|confien?|work|manage|stay home|quedarse en|caja aparte|ni agua|live here|vivir aqui", "desde que|ever since|since they", "se llen[oa]\\w*|invad\\w*|taking over|everywhere",
        "(?:no (?:(?:los|las|les|le) \\w+|deben|deberian|quiero|queremos|se puede|se debe|merecen|deberia)|nunca|jamas|never|do not|dont|should not|shouldnt|must not|will not|wont|must be|should be|hay que|habria que)", "every single one|todos son|son todos|all of them|seguro",
    ],
})
_HATE_TAGS = [(re.compile(r), w) for r, w in [("G.{0,9}[HE]", 0.6), ("[HE].{0,5}G", 0.6), ("id?G", 0.7), ("H[^G]*H", 0.2), ("Gei|GH", 0.6), ("X", 0.7), ("X.{0,9}[HE]|[HE].{0,5}X|Xei", 0.5)]]
_THINGS_TOO = _stems("sucio sucia dirty filthy basura trash garbage rata rats cucaracha roaches cerdo pigs animal animals carga peligro cancer useless inutil ruin mierda bestia kill gas fuera hang burden sick enfermo".split())

_SEX_SAID = _phrases({
    1.0: [
        "se me (?:para|pone dur[oa])|makes? me (?:so )?(?:hard|wet)|estoy (?:bien |muy )?(?:caliente|cachond[oa])", "quit(?:ate|ese|arte) (?:\\w+ )?(?:blusa|ropa|camisa|falda|pantalon|brasier|vestido)|take (?:off your|your) (?:top|clothes|shirt|pants|skirt|bra|panties)(?: off)?",
        "(?:mano|manos|hand|hands) (?:\\w+ ){0,2}(?:bajo|debajo de|under|up) (?:\\w+ )?(?:falda|skirt|vestido|dress|blusa)", "(?:chicas|damas|senoritas) de compania|call girls?", "sexo (?:oral|anal|casual|por dinero|gratis|en vivo|sin compromiso|duro)|(?:oral|anal) sex|sex for money", "(?:encuentros?|servicios?|favores|juegos?) sexual(?:es)?", "(?:his|my|your|mi|tu|su) (?:dick|cock|verga|pene|pito)", "fuck (?:the|my|your|a)", "(?:para|vamos a|quiero|ganas de) coger (?:rico|duro|contigo|esta noche|toda la noche)", "ride (?:me|my|your)", "(?:have|having) sex|sex with",
        "(?:want|like|love|going|gonna) to (?:fuck|bang|screw|lick|suck)|bang you|fuck (?:me|her|him)", "(?:hacer\\w*|haria|hare|hago|make) (?:te )?(?:you )?(?:gritar|gemir|scream|moan)",
    ],
    0.9: ["(?:te|me|se) la (?:quiero |voy a |dejo )?(?:meto|meter|clavo|clavar|chupo|chupar|mamo|mamar|chupas|mamas)", "(?:mandame|pasame|send me|enviame) (?:tu|your|el|un) (?:pack|nudes?|desnudo)", "(?:hacerte|haria|hare) mi[ao]|make you mine|make love to you"],
    0.7: ["tocar\\w* (?:el|la|las|los|tu|tus) (?:cuerpo|pechos|senos|piernas|nalgas)|toque (?:los|las) (?:pechos|senos|nalgas|piernas)", "teniendo (?:sexo|relaciones)|tener relaciones sexuales", "(?:your|her) (?:breasts|thighs|panties)", "final(?:es)? feliz|happy ending", "que llevas (?:puesto|debajo)|what (?:are )?you (?:are )?wear(?:ing)?", "sin (?:ropa|nada puesto)(?: interior)?|(?:with )?nothing on|no clothes", "hot girls", "touch you|tocarte|tocate|touch yourself", "en pelotas?", "grupo privado"],
    0.4: ["(?:toda la|all|esta|this) (?:noche|night)|tonight", "(?:te|le|me la|lo|la) (?:quiero|imagino)|quiero verte|want you", "que (?:ricas?|buenas?) (?:piernas|tetas|nalgas|estas)", "me muero por", "back room|hotel|motel|mi cama|my bed|encima de la mesa", "sin limites|no limits", "contactame|llamame|escribime|escribeme|call me|text me|whatsapp", "por (?:el )?privado|private|dm me|message me", "servicio completo|full service|a domicilio", "la vecina|mi vecina|my neighbou?r"],
})


def _table(*classes: tuple[str, list[str]]) -> dict[str, str]:
    """Class letters by word and by stem; the first class given wins."""
    out: dict[str, str] = {}
    for letter, words in classes:
        for w in words:
            out.setdefault(w, letter)
    for letter, words in classes:
        for w in words:
            if len(stem(w)) > 3:
                out.setdefault(f"~{stem(w)}", letter)
    return out


_ABUSE_CLASS = _table(("y", X.YOU), ("s", X.INSULT), ("i", X.SWEAR), ("W", sorted(set(X.WEAK) - set(X.SAID_OF_THINGS))), ("w", X.WEAK), ("m", X.BEAST), ("t", ["te", "les", "os"]), ("u", ["le", "lo", "se"]), ("h", ["ojala", "hope", "wish"]), ("f", "voy vamos va vas ire will ll gonna going wanna quiero want".split()),
    ("n", ["nadie", "nobody"]), ("q", X.LIKED), ("x", X.HARM), ("p", X.PERSON), ("k", X.COPULA), ("o", X.COLLECTIVE), ("e", "de del of en in from con with at on".split()), ("b", X.BODY), ("g", X.WEAPON), ("S", X.SELF_HARM), ("d", X.FILLER),
    ("z", "dice dijo contesta contesto responde respondio grita grito atendio cobro told said says sabe".split()))
_HATE_CLASS = _table(("X", X.SLURS), ("H", [*X.DEGRADING, *X.INSULT]), ("E", X.EXCLUDING), ("k", X.COPULA), ("e", ["de", "of"]), ("i", X.SWEAR))
_VERBS = tuple(X.VIOLENCE)
_GROUPS, _SLURS = frozenset(X.GROUPS), frozenset(X.SLURS)
_MODERATION, _HEALTH = frozenset(X.MODERATION), frozenset(X.HEALTH)
#: Words before a group's name that make it an adjective's noun, not an adjective.
_EACH = frozenset("every each single any todo cualquier ningun".split())
_OPENERS = frozenset(X.SWEAR) | frozenset("demasiados demasiadas tantos tantas estos los las esos esas estas todos todas muchos muchas unos unas a de por sin que contratan those these the all many most no seguro empacaron".split())


def _letter(table: dict[str, str], w: str) -> str:
    return "," if w == "," else table.get(w) or table.get(f"~{stem(w)}") or (table.get(w[:-1]) if len(w) > 3 and w[-1] == "s" else None) or "."


def _abuse_letter(w: str) -> str:
    if w.startswith(_VERBS) and not w.startswith(("matan", "parto", "parti", "golpes", "breakf", "cuttin")) or w in ("parto", "parte", "partir", "partire"):
        return "V" if len(w) > 6 and w.endswith(("arte", "irte", "erte", "arlos", "erlos", "arlas")) else "v"
    return _letter(_ABUSE_CLASS, w)


class _Rules:
    """Weighted expressions; most sentences match none, which one search of all shows."""

    def __init__(self, rules: list[tuple[re.Pattern, float]]):
        self.rules, self.any = rules, re.compile("|".join(f"(?:{r.pattern})" for r, _ in rules))

    def __call__(self, text: str) -> float:
        return sum(w for r, w in self.rules if r.search(text)) if self.any.search(text) else 0.0


_UNITED_ANY = re.compile("|".join(r.pattern for r, _ in _UNITED))
_abuse_said, _abuse_tags, _hate_said, _hate_tags, _sex_said = map(_Rules, (_ABUSE_SAID, _ABUSE_TAGS, _HATE_SAID, _HATE_TAGS, _SEX_SAID))


def _hateful(words: list[str], stems: list[str], spoken: str) -> float:
    tags, groups = [], 0
    for i, w in enumerate(words):
        before = words[i - 1] if i else ""
        adjective = w.endswith("s") and before.endswith("s") and before not in _OPENERS and before not in X.COPULA
        if not adjective and (w in _GROUPS or (before in _EACH and f"{w}s" in _GROUPS)):
            tags.append("G")
            groups += 1
        elif stems[i] in _THINGS_TOO:  # said of things as well: only where it is said of the group
            tags.append("H" if any(t in "GX" for t in tags[-8:]) else ".")
        else:
            tags.append(_letter(_HATE_CLASS, w))
    evidence = _hate_said(spoken) + _hate_tags("".join(tags))
    return evidence + 0.4 if groups and evidence >= 0.6 else evidence if "X" in tags else 0.0


_ALL_SAID = [r.pattern for rules in (_ABUSE_SAID, _HATE_SAID, _SEX_SAID, _UNITED) for r, _ in rules]
_STARTS = [(r, 1.0) for r, _ in _UNITED] + [x for rules in (_ABUSE_SAID, _HATE_SAID, _SEX_SAID) for x in rules]
_SPOKEN = tuple(sorted({p[:5] for r, w in _STARTS for p in re.findall("[a-z]{4,}" if w >= 0.9 else "[a-z]{5,}", r.pattern)} | {"vend", "vind", "asco", "den"}))
#: Beginnings of words that the phrases complete by a pattern.
_BEGUN = tuple(sorted({p for r in _ALL_SAID for p in re.findall(r"[a-z]{3,4}(?=\\w|\(\?:|\[|[a-z]?\?)", r)} | {"hac", "haz", "har", "ven", "vin"}))


@lru_cache(maxsize=200_000)
def _tells(word: str) -> bool:
    """Whether a word can be part of a case: it has a telling class or begins like a word of
    the phrases."""
    return _abuse_letter(word) in "sSwWmiVvxgoqhnb" or stem(word) in _SEXUAL or word in _GROUPS or word in _SLURS or f"{word}s" in _GROUPS or word.startswith(_SPOKEN)


@lru_cache(maxsize=200_000)
def _masked(word: str) -> str:
    """The word, or a stand-in for one that no class and no phrase knows."""
    known = len(word) <= 4 or _tells(word) or _abuse_letter(word) != "." or _letter(_HATE_CLASS, word) != "." or word in _MODERATION or word in _HEALTH or word.startswith(_BEGUN) or (word.endswith("s") and word in _OPENERS)
    return word if known else "otras" if word.endswith("s") else "otra"


def score_words(words: list[str]) -> tuple[float, float, float]:
    """Scores of one sentence of restored words."""
    return _scored(tuple(map(_masked, words))) if any(map(_tells, words)) else (0.0, 0.0, 0.0)


@lru_cache(maxsize=200_000)
def _scored(words: tuple[str, ...]) -> tuple[float, float, float]:
    text = " ".join(words)
    if _UNITED_ANY.search(text):
        for r, w in _UNITED:
            text = r.sub(w, text)
        words = text.split()
    spoken = text.replace(" ,", "")
    stems = [stem(w) for w in words]

    tags = "".join(map(_abuse_letter, words))
    abusive = _abuse_said(spoken) + _abuse_tags(tags) + (0.4 if "y" in tags and ("m" in tags or "w" in tags or "W" in tags) else 0.0)

    hateful = 0.0
    if any(w in _GROUPS or w in _SLURS or f"{w}s" in _GROUPS for w in words):
        hateful = _hateful(words, stems, spoken)
    if hateful >= THRESHOLD and not re.search("y[kd]*[swWmi]|p(?:e.{0,2}?)?d*k[kd]*[swWmi]|[tfh].*[vVx]", tags):
        abusive = 0.0  # an attack on a group isn't also one on a person

    own = {w: weight for s in stems if s in _SEXUAL for weight, w in (_SEXUAL[s],)}
    core = max(own.values(), default=0.0)
    said = _sex_said(spoken)
    sexual = sum(own.values()) + said
    if core < 0.5 and said < 0.7:
        sexual = 0.0
    if core < 1.0 and any(w in _HEALTH for w in words):
        sexual -= 0.6
    if any(w in _MODERATION for w in words):
        sexual -= 1.5
    return max(abusive, 0.0), max(hateful, 0.0), max(sexual, 0.0)


class Scorer:
    """Scores texts; sentences that occur again are looked up."""

    def __init__(self, restorer: Restorer):
        self._sentence = lru_cache(maxsize=200_000)(lambda s: score_words(restorer.words(s)))

    def text(self, text: str | None) -> list[float]:
        """Scores of a text's worst sentences."""
        best = [0.0, 0.0, 0.0]
        for sentence in _SENTENCE.split(normal(text or "")):
            if sentence and not sentence.isspace():
                # numbers say nothing here; without them more sentences are known already
                best = [max(a, b) for a, b in zip(best, self._sentence(_NUMBER.sub("0", sentence)), strict=True)]
        return best


def _grams(word: str, k: int) -> Column:
    pieces = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.col(word).substr(i, F.lit(k)))
    return F.filter(pieces, lambda g: F.length(g) == k)


def letter_counts(documents: DataFrame) -> DataFrame:
    """Character n-grams of all words of letters of all documents, weighted by the square
    roots of the words' counts."""
    folded = F.lower(F.translate(F.coalesce("text", F.lit("")), "ÁÉÍÓÚÜÑáéíóúüñ", "AEIOUUNaeiouun"))
    words = documents.select(F.explode(F.split(folded, "[^a-z0-9]+")).alias("word")).where("word rlike '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n"))
    padded = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"), F.sqrt("n").alias("n"))
    grams = padded.select("n", F.explode(F.flatten(F.array(*[_grams("w", k) for k in range(1, ORDER + 1)]))).alias("gram"))
    return grams.groupBy("gram").agg(F.ceil(F.sum("n")).alias("n"))


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): scores of the restored text."""
    sc = documents.sparkSession.sparkContext
    # at most 28^4 rows whatever the corpus
    counts = sc.broadcast({r.gram: int(r.n) for r in letter_counts(documents).collect()})

    def run(batches):
        scorer = Scorer(Restorer(CharModel(counts.value)))
        for pdf in batches:
            s = [scorer.text(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source} | {c: [x[k] for x in s] for k, c in enumerate(CATEGORIES)})

    source = F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source")
    return documents.select("doc_id", source, "text").mapInPandas(run, "doc_id long, source string, abusive double, hateful double, sexual double")


def found(scored: DataFrame) -> DataFrame:
    each = F.explode(F.filter(F.array(*[F.when(F.col(c) >= THRESHOLD, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull()))
    return scored.select("doc_id", each.alias("category"))


def rates(scored: DataFrame) -> DataFrame:
    """Documents and flagged shares per source."""
    n = F.count("*")
    flagged = F.greatest(*CATEGORIES) >= THRESHOLD
    return scored.groupBy("source").agg(n.alias("documents"), *[F.count_if(F.col(c) >= THRESHOLD).alias(f"n_{c}") for c in CATEGORIES], F.round(F.count_if(flagged) / n, 6).alias("flagged_share"))
