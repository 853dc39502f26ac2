"""Broken prompt and response pairs.

The words of the response run through a suffix automaton of the prompt, which gives the share of the response
that is copied. Refusals are found by an Aho-Corasick automaton over first-person phrases, cut-off answers by
a stack of delimiters and the way the text ends, answers in another language by votes of stopwords.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.workers import map_columns, spread

# Texts that stand for no value, once markup and punctuation are gone.
STAND_INS = frozenset(
    "null|none|nil|nan|na|n a|undefined|void|empty|blank|missing|no output|no answer|no response|no value|no result|no data|no content|not available|not applicable|not set|tbd|todo|placeholder|"
    "insert answer here|answer|response|output|lorem ipsum|keine ausgabe|keine antwort|leer|sin respuesta|sin salida|vacío|sans réponse|aucune réponse|vide|sem resposta|vazio|nessuna risposta|vuoto".split("|")
)
STAND_IN_WORDS = max(len(x.split()) for x in STAND_INS)
# Words that may stand around a repeated prompt without answering it.
LABELS = frozenset("instruction question prompt user human task input query request q you asked ask me the original here is your i was frage anweisung aufgabe pregunta instrucción pergunta instrução consigne domanda istruzione richiesta".split())

# Refusals in the first person, in lower case with plain apostrophes.
REFUSALS = {
    "en": """i can't|i cannot|i can not|i won't|i will not|i'm unable to|i am unable to|i'm not able to|i am not able to|i am not allowed|i'm not allowed|i'm not permitted|i am not permitted|i must decline|i have to decline|
    i must refuse|i have to refuse|i must refrain|i have to refrain|i would prefer not|i'd prefer not|i'd rather not|i would rather not|i prefer not|i refuse|i decline|i respectfully decline|i don't feel comfortable|i do not feel comfortable|
    i'm not comfortable|i am not comfortable|i can neither|i have to pass|i'll have to pass|i must pass|i have to stay silent|i must stay silent|i shall not|i do not wish|i don't want to|i am not going to|i'm not going to|i may not|i am forbidden|
    i'm forbidden|i am prohibited|i am not authorized|i'm not authorized|i'm not in a position|i am not in a position|i don't discuss|i do not discuss|i don't provide|i do not provide|i do not answer|i don't answer|i could not possibly|i couldn't possibly|
    my guidelines|my policies|my policy|my rules|my principles|my safety|my programming|not something i can|not something i am|not something i'm|something i cannot|something i can't|something i won't|something i will not|outside of what i|outside what i|
    beyond what i|not possible for me|impossible for me|inappropriate for me|not appropriate for me|not comfortable with|no answer to this|no answer can be given|no answer will|no comment from me|prevent me from|prevents me from|keep me from|keeps me from|
    turn that request down|turn this request down|turning this down|turning that down|turn you down|turn this one down|i'll pass on|i will pass on|i'm passing on|i am passing on|i'll sit this one out|i'd sooner not|i would sooner not|leave that unanswered|leave this unanswered|i'm declining|i am declining|i'm refusing|i am refusing|that's a no from me|i'll leave that to|not going to help|won't be answering|won't be helping|i'll have to say no|i have to say no|i must say no|i'll refrain|forbid me|forbids me|not allow me|doesn't allow me|don't allow me|what i am allowed to|what i'm allowed to|sorry, no.|sorry, but no|against my|you'll have to ask someone else|count me out""",
    "de": """kann ich leider nicht|kann ich nicht|kann ich dir nicht|kann ich ihnen nicht|ich kann nicht|ich kann dabei nicht|ich kann ihnen dabei nicht|ich kann dir dabei nicht|ich kann das nicht|darf ich nicht|darf ich leider nicht|ich darf|darf nichts|nicht gestattet|nicht erlaubt|
    keine auskunft|lehne ich ab|ich lehne|muss ich ablehnen|ich muss ablehnen|muss ich leider ablehnen|ich möchte|möchte ich nicht|möchte ich lieber nicht|ich verweigere|ich weigere mich|werde ich nicht|ich werde nicht|nicht helfen|nicht weiterhelfen|
    meine richtlinien|meine regeln|meine vorgaben|tut mir leid, aber|tut mir leid, das|tut mir leid, nein|untersagen mir|verbieten mir|ist mir untersagt|ist mir verboten|ich äußere mich|sage ich nichts|bin ich nicht befugt|ich bin nicht befugt""",
    "fr": """je ne peux pas|je ne peux ni|je ne suis pas|je ne saurais|je dois décliner|je dois refuser|je dois m'abstenir|je décline|je refuse|je préfère ne|je préfère m'abstenir|je préférerais ne|c'est non|m'interdi|m'empêch|je n'expliquerai|je n'ouvrirai|je ne|je n'ai pas le droit|
    je n'ai pas l'autorisation|impossible de vous|il m'est impossible|m'est pas permis|m'est pas possible|ne me permettent pas|ne me permet pas|mes règles|mes consignes|je regrette, mais""",
    "es": """no puedo|no me está|no me es posible|no me es permitido|me niego|mis normas|mis reglas|mis directrices|mis políticas|prefiero no|preferiría no|no voy a|lo siento, pero no|lo lamento, pero no|debo declinar|debo rechazar|tengo que rechazar|tengo que negarme|debo negarme|debo abstenerme|
    me impiden|me impide|no me permiten|no me permite|no estoy autoriz|me abstengo|me temo que no|rechazo|no haré|no responderé|no explicaré|me prohíben|tengo prohibido""",
    "pt": """não posso|não me é|tenho de recusar|tenho que recusar|devo recusar|recuso|prefiro não|preferia não|não vou|minhas regras|minhas diretrizes|minhas normas|minhas políticas|lamento, mas não|desculpe, mas não|não estou autoriz|me impedem|impedem-me|não me deixam|não deixam|
    não me permitem|não tenho permissão|não consigo ajudar|sou obrigado a recusar|abstenho-me|devo abster-me|não irei|proíbem-me|me proíbem""",
    "it": """non posso|mi dispiace, ma non|devo rifiutare|devo declinare|mi rifiuto|preferisco non|preferirei non|non mi è|non sono autorizzat|non intendo|le mie regole|le mie linee guida|mi impediscono|non mi permettono|non mi consentono|non parlerò|non spiegherò""",
    "nl": """kan ik niet|ik kan niet|ik kan je niet|ik kan u niet|mag ik niet|ik mag niet|ik weiger|moet ik weigeren|ik wil liever niet|ik ga niet|het spijt me, maar""",
    "ru": """я не могу|не могу помочь|не могу ответить|не могу обсуждать|вынужден отказать|я отказываюсь|мне не разрешено|мне запрещено|я не буду|предпочитаю не""",
    "ja": """お答えできません|お手伝いできません|お断り|できかねます|控えさせて|申し訳ありませんが|回答できません|対応できません|応じられません""",
    "zh": """我无法|我不能|无法提供|无法回答|抱歉，我|拒绝回答|恕我""",
    "ko": """도와드릴 수 없|답변할 수 없|말씀드릴 수 없|거절|죄송하지만""",
    "tr": """yardımcı olamam|yardım edemem|cevap veremem|yanıtlayamam|reddediyorum|reddetmek zorunda|izin vermiyor""",
    "pl": """nie mogę|odmawiam|muszę odmówić|wolę nie""",
}
# What follows such a phrase where it reports a result instead of refusing.
REPORTS = ("find", "see", "spot", "locate", "detect", "reproduce", "recall", "tell from", "trigger", "name any", "rule out", "identify any", "discover", "finden", "sehen", "erkennen", "reproduzieren", "trouver", "reproduire", "trouve", "encontrar", "reproducir", "ver ", "reproduzir", "trovare")
# After these phrases a refusal needs a negation in the same sentence.
NEEDS_NOT = {"ich darf": "nicht", "ich möchte": "nicht", "je ne": "pas", "my guidelines": " not ", "my policies": "prevent", "my rules": " not ", "my policy": " not ", "my principles": " not ", "my safety": " not ", "my programming": " not ", "meine richtlinien": "", "mes règles": "", "mes consignes": ""}

# Frequent short words by language; a word in several languages shares its vote.
STOPWORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any my now such like our over me even most made after also did many off before must through much where your way down should because each those between without while whose how why does show list tell explain look check compare run suggest got mean every please found".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine einer eines einem als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum kann nur ihr seine aber vor durch man oder wenn war können im vom zur deren dessen diese dieser dieses deshalb weil welche welchen welches warum wurde wurden bitte mir ich wir hier gern deren keine kein haben sollte bleiben offen soll datei zeile prüfe erkläre regeln".split(),
    "fr": "le la les de des du un une et est à en que qui dans pour pas sur ce cette ces il elle au aux avec par plus ne se sont ont été être son sa ses leur mais ou où donc car si nous vous je l'argument d'une qu'un pourquoi quelles quelle quels comment après avant fichier règle même aussi cela tout toute peut faut reste parce ligne corriger explique analyse cherche couvrent voici quoi".split(),
    "es": "el la los las de del un una y es en que por para con no se lo su sus al como más pero ha sido son está este esta estos estas le les ya o muy sin sobre también hasta hay donde quien desde todo nos cuando porque qué cómo cuál cuáles después antes archivo regla ninguna así casi viene puede explica reglas hallazgo línea busca cubren corrijo conviene".split(),
    "pt": "o a os as de do da dos das um uma e é em no na nos nas que por para com não se seu sua ao aos à como mais mas foi são está este esta isto isso já ou muito sem sobre também até quando porque depois antes ficheiro arquivo regra pelo pela pode explica quais qual tratam corrijo linha quanto verifica convém nenhuma vem ser".split(),
    "it": "il lo la i gli le di del della dei delle un una uno e è in che per con non si al alla alle come più ma ha sono questo questa anche da dal dalla nel nella ed o se su quindi senza può prima dopo chi cui stato regola file valore bisogna conviene perché quale quali".split(),
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om als bij ook maar dan door naar uit wordt deze dit heeft over nog kan tot of wat die worden moet zonder daarom welke waarom regel bestand geen".split(),
    "sv": "och att det som en på är av för med den till inte om har de ett men var från vid kan så ska under efter utan eller detta denna vilka varför där måste".split(),
    "da": "og at det som en på er af for med den til ikke om har de et men var fra ved kan så skal under efter uden eller dette denne hvilke hvorfor der blev".split(),
    "pl": "i w na z że się do nie jest to od o jak po co dla przez ale oraz przed tak lub już który która które jego jej być może bez więc plik reguła wartość ponieważ".split(),
    "cs": "a se na v je že s z do o i to k ve pro za by ale jako po od který která které není být před nebo proto když hodnota pravidlo soubor".split(),
    "tr": "ve bir bu da de için ile çok daha ne olan olarak gibi ama kadar sonra önce her değeri kural hiçbir bu yüzden değişiklikten yeniden istekten gelen çalıştırın doğrulayın işlevine ulaşıyor dosyayı geçmeden taraf veya değil çağıran".split(),
    "ro": "și în de la cu pe nu este că o un care mai din pentru sau se ce să dar fi sunt după acest această fără valoarea regula fișierul".split(),
    "fi": "ja on ei se että oli hän mutta ovat kun niin myös tai kuin jos joka ennen jälkeen ilman tämä siksi tiedosto sääntö arvo".split(),
    "hu": "a az és hogy nem is egy van ez meg de ha már csak vagy után előtt ezért szabály fájl érték minden".split(),
    "vi": "và của là có không được cho với trong một các này đó để khi đã sẽ từ như cũng nhưng hoặc vì nếu những người thì phải bị tệp giá trị quy tắc".split(),
    "hr": "i u na se je da za su od s kao koji koja koje ali ili nije što kako samo može treba bez prije nakon zbog ovaj ova ovo jer datoteka pravilo vrijednost biti bio".split(),
    "sl": "in v na se je da za so od z kot ki pa ali ni kaj kako samo lahko mora brez pred po zaradi ta to ker datoteka pravilo vrednost biti bil tudi še".split(),
    "tl": "ang ng sa mga na ay at hindi para kung ito iyon may wala dahil upang bago pagkatapos din rin lamang maaari dapat siya sila namin natin".split(),
    "id": "yang dan di ke dari untuk dengan ini itu tidak adalah pada akan atau juga oleh sebagai karena setelah sebelum nilai aturan berkas tanpa dapat".split(),
}
# Letters that hardly any other of these languages has, as votes.
LETTERS = {"ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "ß": "de", "ä": "de", "ü": "de", "ğ": "tr", "ı": "tr", "ş": "tr", "ł": "pl", "ą": "pl", "ę": "pl", "ř": "cs", "ě": "cs", "ů": "cs", "ș": "ro", "ț": "ro", "ő": "hu", "ű": "hu", "œ": "fr", "đ": "vi", "ơ": "vi", "ư": "vi", "č": "hr", "ć": "hr", "å": "sv", "ø": "da", "æ": "da"}
# Scripts that tell a language by themselves.
SCRIPTS = (("HIRAGANA", "ja"), ("KATAKANA", "ja"), ("HANGUL", "ko"), ("CJK", "zh"), ("CYRILLIC", "ru"), ("ARABIC", "ar"), ("HEBREW", "he"), ("GREEK", "el"), ("DEVANAGARI", "hi"), ("THAI", "th"), ("BENGALI", "bn"), ("TAMIL", "ta"), ("GEORGIAN", "ka"), ("ARMENIAN", "hy"))
# How the languages are called, as word beginnings.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglês inglese engels",
    "de": "german deutsch allemand alemán aleman alemão tedesco duits",
    "fr": "french franz français francais francés frances francês francese frans",
    "es": "spanish spanisch espagnol español espanol castellano espanhol spagnolo spaans",
    "pt": "portuguese portugiesisch portugais portugués português portugues portoghese portugees",
    "it": "italian italienisch italien italiano",
    "nl": "dutch niederländisch néerlandais holandés neerlandés holandês olandese nederlands",
    "ja": "japanese japanisch japonais japonés japonês giapponese japans 日本語",
    "zh": "chinese mandarin chinesisch chinois chino chinês cinese 中文",
    "ko": "korean koreanisch coréen coreano 한국어",
    "ru": "russian russisch russe ruso russo русск",
    "ar": "arabic arabisch arabe árabe arabo",
    "tr": "turkish türkisch turc turco türkçe",
    "pl": "polish polnisch polonais polaco polonês polacco polski",
    "sv": "swedish schwedisch suédois sueco svedese svenska",
    "hi": "hindi",
    "el": "greek griechisch grec griego grego greco",
    "cs": "czech tschechisch tchèque checo tcheco ceco",
    "da": "danish dänisch danois danés dinamarquês danese dansk",
    "fi": "finnish finnisch finnois finlandés finlandês finlandese suomi",
    "hu": "hungarian ungarisch hongrois húngaro ungherese magyar",
    "ro": "romanian rumänisch roumain rumano romeno rumeno română",
    "id": "indonesian indonesisch indonésien indonesio indonésio indonesiano",
}
WORD = re.compile(r"[^\W_]+(?:['’_][^\W_]+)*", re.UNICODE)
FENCE = re.compile(r"```[^\n`]*\n?.*?```", re.DOTALL)
EMPTY_FENCE = re.compile(r"```[^\n`]*\s*```")
TAG = re.compile(r"<[^<>\n]{0,60}>")
INLINE = re.compile(r"`[^`\n]*`")
QUOTED = re.compile(r"\"[^\"\n]{12,}\"|“[^”\n]{12,}”|«[^»\n]{12,}»|„[^“”\n]{12,}[“”]|^>.*$", re.MULTILINE)
UNSEEN = regex.compile(r"(?V1)[[\p{Cf}\p{Cc}\p{Cn}\p{Co}ㅤᅟᅠ⠀]--[\n\t]]")
ASCII_CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
OPEN_FENCE = re.compile(r"```[^\n`]*\n?(.*?)(?:```|\Z)", re.DOTALL)
ITEM_BREAK = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*+•#|]|\d+[.)])\s)")
SENTENCE_END = re.compile(r"[.!?…]+(?=\s)|[。！？]+|¶")
# Brief answers that are complete without a full stop.
BRIEF = re.compile(
    r"(?i)(?:yes|no|nope|yep|correct|right),?\s+(?:it|they|he|she|we|you|i|that|this|there|both|neither)\s+(?:is|are|was|were|does|do|did|has|have|had|can|could|will|would|should|must)(?:n't|\s+not)?"
    r"|(?:ja|nein|oui|non|s[íi]|no|sim|não|sì),?\s+(?:das ist so|das stimmt|c'est le cas|c'est exact|es así|lo es|é|está|lo è)"
    r"|(?:[^\W\d_]+\s+){1,4}(?:is|are|was|were)\s+(?:not\s+\w+ed|un\w+ed|un\w+able|in\w+[ai]ble|correct|fine|safe|unsafe|wrong|missing|empty|true|false)"
)
#: A refusal has at least one refusing sentence in so many.
REFUSING_ONE_IN = 6
TERMINAL = ".!?。！？…؟۔।॥․:;"
CLOSERS = "\"'”’»)]}`*_>|」』）】~"
PAIRS = {")": "(", "]": "[", "}": "{"}


@lru_cache(maxsize=64)
def visible(text: str) -> str:
    """`text` without characters that show nothing (controls, format characters, fillers)."""
    return ASCII_CONTROLS.sub("", text) if text.isascii() else UNSEEN.sub("", text)


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, bare markup, or a stand-in for no value."""
    if text is None:
        return True
    rest = visible(text)
    words: list[str] = []
    for m in WORD.finditer(TAG.sub(" ", EMPTY_FENCE.sub(" ", rest))):
        if len(words) == STAND_IN_WORDS:
            return False  # longer than any stand-in
        words.append(m.group().lower())
    return not words or " ".join(words) in STAND_INS


class SuffixAutomaton:
    """The suffix automaton of a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            new = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.length[q := self.next[p][w]] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = self._state(dict(self.next[q]), self.length[p] + 1)
                self.link[copy] = self.link[q]
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
            last = new

    def _state(self, arcs: dict[str, int], length: int) -> int:
        self.next.append(arcs)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def matches(self, words: list[str]) -> list[int]:
        """For each place of `words` the length of the longest run ending there that the sequence contains."""
        state = matched = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            out.append(matched)
        return out


def copied(prompt: list[str], response: list[str], least: int = 2) -> tuple[list[bool], int]:
    """Which words of `response` lie in a run of at least `least` words that `prompt` has too; the longest run."""
    if not prompt or not response:
        return [False] * len(response), 0
    runs = SuffixAutomaton(prompt).matches(response)
    covered, until = [False] * len(runs), 0
    for end in range(len(runs) - 1, -1, -1):
        if runs[end] >= least:
            until = max(until, runs[end])
        if until:
            covered[end] = True
            until -= 1
    return covered, max(runs)


def _words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def copied_share(instruction: str | None, output: str | None) -> float:
    """The share of the output's words that it copies from the instruction; 0 without words."""
    covered, _ = copied(_words(instruction or ""), words := _words(output or ""))
    return sum(covered) / len(words) if words else 0.0


def is_echo(instruction: str | None, output: str) -> bool:
    """The output gives the instruction back, whatever its case, spacing, punctuation and markup, and nothing else."""
    prompt = _words(instruction or "")
    allowed = LABELS.union(prompt)
    folded = output.casefold()
    if len(prompt) < 2 or not all(m.group() in allowed for m in WORD.finditer(folded)):
        return False
    response = WORD.findall(folded)
    covered, longest = copied(prompt, response)
    left = [w for w, c in zip(response, covered, strict=True) if not c and w not in LABELS]
    blocks = [len(_words(b)) for b in re.split(r"\n\s*\n|(?<=[.:?!])\s+", instruction or "") if b.strip()]
    whole = min([n for n in blocks if n >= 4], default=len(prompt))
    return not left and longest >= max(2, 0.8 * min(whole, len(prompt)))


@lru_cache(maxsize=1)
def _refusal_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrases in REFUSALS.values():
        for phrase in (p.strip() for p in phrases.replace("\n", "").split("|")):
            if phrase:
                automaton.add_word(phrase, phrase)
    automaton.make_automaton()
    return automaton


def is_refusal(output: str, instruction: str | None = None) -> bool:
    """The output declines to answer: it says so in the first person, in at least one of `REFUSING_ONE_IN` of its sentences.

    Quotations don't count. Each line of a code block counts as a sentence of an answer, unless the instruction has the same line.
    """
    given = {line.strip() for line in (instruction or "").split("\n")}
    code = sum(bool(line.strip()) and line.strip() not in given for block in OPEN_FENCE.findall(output) for line in block.split("\n"))
    text = QUOTED.sub(" ", OPEN_FENCE.sub("\n\n", output)).replace("’", "'").replace("‘", "'").lower()
    text = " " + re.sub(r"\s+", " ", ITEM_BREAK.sub(" ¶ ", visible(text))).strip() + " "
    hits = list(_refusal_automaton().iter(text))
    if not hits:
        return False
    latin = text.isascii() or not any(unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL")) for c in text if c.isalpha())
    ends = [m.end() for m in SENTENCE_END.finditer(text)] + [len(text)]
    refusing = set()
    for end, phrase in hits:
        start = end - len(phrase) + 1
        if latin and text[start - 1].isalnum():
            continue
        if phrase[-1].isalnum() and latin and text[end + 1].isalnum() and phrase not in ("m'interdi", "m'empêch", "no estoy autoriz", "não estou autoriz", "non sono autorizzat", "recuso"):
            continue
        after = text[end + 1 :]
        if after.lstrip().startswith(REPORTS):
            continue
        needed = NEEDS_NOT.get(phrase)
        if needed and needed not in re.split(r"[.!?]", after)[0] + " ":
            continue
        refusing.add(bisect_right(ends, end))
    sentences = sum(any(c.isalnum() for c in text[a:b]) for a, b in zip([0, *ends], ends, strict=False))
    return bool(refusing) and len(refusing) * REFUSING_ONE_IN >= sentences + code


def _prose(text: str) -> str:
    """`text` without code blocks, inline code, quotations and list markers."""
    return QUOTED.sub(" ", INLINE.sub(" ", FENCE.sub(" ", text)))


def _is_name(word: str) -> bool:
    """A rule, path, number or identifier rather than a word of prose."""
    return any(c.isdigit() or c in "_/\\.:#=-" for c in word.strip(".,;:")) or (len(word) > 1 and word.isupper())


def is_truncated(output: str) -> bool:
    """The output breaks off before its sentence, list, call or code is complete."""
    text = visible(output).rstrip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    for block in re.findall(r"```(?:tool_call|json)[^\n`]*\n(.*?)```", text, re.DOTALL):
        try:
            json.loads(block)
        except ValueError:
            return True
    if text.endswith("```"):
        return False
    open_marks: list[str] = []
    for c in INLINE.sub(" ", FENCE.sub(" ", text)):
        if c in "([{":
            open_marks.append(c)
        elif c in PAIRS and open_marks and open_marks[-1] == PAIRS[c]:
            open_marks.pop()
    if open_marks and not re.search(r"[:;]-?[(\[]", text):
        return True
    if FENCE.sub(" ", text).count("`") % 2:
        return True
    line = text.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:\d+[.)]|[-*•+]|#+)", line) and len(text) > len(line):
        return True
    if (line.count('"') % 2 and text.count('"') % 2) or text.count("“") > text.count("”") + text.count("„") and line.count("“"):
        return True
    bare = text.rstrip(CLOSERS + " ")
    last = (bare or text)[-1]
    if last in ".!?。！？؟۔।॥":
        return False
    if last == "…":
        return False
    if last in ",:;(（[{、，：；=+&/\\<–—" or (last == "-" and len(text) > 1):
        return True
    # without a full stop only names, numbers and lists of them are complete
    tail = re.sub(r"^\s*(?:\d+[.)]|[-*•+]|#+|\|)\s*", "", line)
    if line.startswith("|") and line.endswith("|"):
        return False
    if re.search(r"[\u3040-\u30ff\u3400-\u9fff]$", tail) and len(tail) > 8:
        return True  # scripts that put no blanks between words
    words = tail.split()
    names = [w for w in words if _is_name(w.strip("\"'`*()[],;"))]
    return not (len(text.split()) == 1 or len(names) == len(words) or BRIEF.fullmatch(text))


@lru_cache(maxsize=1)
def _votes_of() -> dict[str, tuple[tuple[str, ...], float]]:
    languages: dict[str, list[str]] = {}
    for language, words in STOPWORDS.items():
        for w in set(words):
            languages.setdefault(w, []).append(language)
    return {w: (tuple(ls), 1 / len(ls)) for w, ls in languages.items()}


@lru_cache(maxsize=8192)
def _script_of(c: str) -> str | None:
    name = unicodedata.name(c, "")
    return next((language for script, language in SCRIPTS if name.startswith(script)), None)


def language_votes(text: str) -> dict[str, float]:
    """Votes by language for a text of prose: stopwords, telling letters, and scripts other than Latin."""
    votes: dict[str, float] = {}
    known = _votes_of()
    for w, n in Counter(WORD.findall(text.lower().replace("’", "'"))).items():
        hit = known.get(w)
        if hit is None and "'" in w:
            hit = known.get(w.rsplit("'", 1)[-1])
            if w[:2] in ("l'", "d'", "n'", "s'", "c'", "j'", "m'") or w[:3] == "qu'":
                votes["fr"] = votes.get("fr", 0) + 0.5 * n
        if hit:
            for language in hit[0]:
                votes[language] = votes.get(language, 0) + hit[1] * n
        if not w.isascii():
            for c in w:
                if c in LETTERS:
                    votes[LETTERS[c]] = votes.get(LETTERS[c], 0) + 0.5 * n
                    break
    if not text.isascii():
        for mark in "¿¡":
            if mark in text:
                votes["es"] = votes.get("es", 0) + 1
        counts: dict[str, int] = {}
        for c, n in Counter(text).items():
            if ord(c) > 0x36F and c.isalpha() and (language := _script_of(c)):
                counts[language] = counts.get(language, 0) + n
        if counts.get("ja") and counts.get("zh"):
            counts["ja"] += counts.pop("zh")
        for language, n in counts.items():
            votes[language] = votes.get(language, 0) + n / 2
    return votes


def language_of(text: str, least: float = 1.0) -> str | None:
    """The language with most votes, or None where no language has `least`."""
    votes = language_votes(text)
    best = max(votes, key=lambda k: (votes[k], k), default=None)
    return best if best and votes[best] >= least else None


@lru_cache(maxsize=1)
def _asks() -> re.Pattern:
    names = "|".join(re.escape(n) for line in LANGUAGE_NAMES.values() for n in line.split())
    return re.compile(rf"(?<!\w)({names})", re.IGNORECASE)


def languages_asked_for(instruction: str) -> set[str]:
    """The languages that the instruction names."""
    found = {m.lower() for m in _asks().findall(instruction)}
    return {language for language, line in LANGUAGE_NAMES.items() if found & set(line.split())}


def _instruction_language(instruction: str) -> str | None:
    """The language that most paragraphs of the instruction are in, of equal ones the first; of its whole prose if no paragraph has one.

    Paragraphs and not words count, so a long text handed over with a question does not outvote it.
    """
    spoken = [language for part in re.split(r"\n\s*\n", FENCE.sub(" ", instruction)) if (language := language_of(INLINE.sub(" ", part), least=0.4))]
    return max(spoken, key=spoken.count) if spoken else language_of(_prose(instruction), least=0.4)


def is_other_language(instruction: str | None, output: str) -> bool:
    """The output's prose is in another language than the instruction, which does not name that language."""
    if not instruction:
        return False
    prose = _prose(output)
    votes = language_votes(prose)
    if not votes:
        return False
    said = max(votes, key=lambda k: (votes[k], k))
    if votes[said] < 1.5:
        return False
    asked_in = _instruction_language(instruction)
    if asked_in is None or said == asked_in or said in languages_asked_for(instruction):
        return False
    return votes[said] >= 1.6 * votes.get(asked_in, 0) + 0.5


def defect_of(instruction: str | None, output: str | None) -> str | None:
    """The type of the defect of a pair, or None. A pair with several has the first of: empty, echo, refusal, truncated, other_language."""
    if is_empty(output):
        return "empty"
    if is_echo(instruction, output):
        return "echo"
    if is_refusal(output, instruction):
        return "refusal"
    if is_truncated(output):
        return "truncated"
    if is_other_language(instruction, output):
        return "other_language"
    return None


def find_defects(pairs: DataFrame, *, id_column: str = "pair_id", instruction: str = "instruction", output: str = "output") -> DataFrame:
    """pair_id, defect of each defective pair.

    Repeated pairs each come out. A null output is empty; with a null or blank instruction no echo and no
    other language can be told. Texts are read whole. No pairs, no rows; other columns are not read.
    """

    def run(columns: dict) -> dict:
        found = [(i, d) for i, p, r in zip(columns["i"], columns["p"], columns["r"], strict=True) if (d := defect_of(p, r))]
        return {"pair_id": pa.array([i for i, _ in found], pa.int64()), "defect": pa.array([d for _, d in found], pa.string())}

    return map_columns(spread(pairs.select(F.col(id_column).cast("long").alias("i"), F.col(instruction).alias("p"), F.col(output).alias("r"))), run, "pair_id long, defect string")


def describe_pairs(pairs: DataFrame, *, id_column: str = "pair_id", instruction: str = "instruction", output: str = "output") -> DataFrame:
    """pair_id, defect (null for sound pairs), copied_share, instruction_language, output_language of every pair."""

    def run(columns: dict) -> dict:
        rows = list(zip(columns["p"], columns["r"], strict=True))
        return {
            "pair_id": pa.array(columns["i"], pa.int64()),
            "defect": pa.array([defect_of(p, r) for p, r in rows], pa.string()),
            "copied_share": pa.array([copied_share(p, r) for p, r in rows], pa.float64()),
            "instruction_language": pa.array([language_of(_prose(p or "")) for p, _ in rows], pa.string()),
            "output_language": pa.array([language_of(_prose(r or "")) for _, r in rows], pa.string()),
        }

    return map_columns(
        spread(pairs.select(F.col(id_column).cast("long").alias("i"), F.col(instruction).alias("p"), F.col(output).alias("r"))),
        run,
        "pair_id long, defect string, copied_share double, instruction_language string, output_language string",
    )
