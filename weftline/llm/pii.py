"""Personal information inside free text: where it is, and readable replacements for it.

Items are found by their form and by the words around them. A person's name counts where its surroundings prove it (a form
of address, an initial, a trailer, a mail address); what such places say about given names and surnames is gathered over
the whole corpus, and other capitalised words count as a name if that evidence, the form of the surname or the
sentence speaks for a person. No list of names is used.

Items are replaced either by typed placeholders, numbered so that the same item keeps its number in a text, or by
surrogates. These come from keyed permutations of the letters and digits that an item consists of, vowels to vowels,
digits to digits, each script to itself: different items never get the same surrogate, in no text and without any
exchange, and each part of a name has one surrogate wherever and however the name is written.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZERS
from weftline.llm.workers import map_columns, spread
from weftline.session import cut

TYPES = ("email", "phone", "id_number", "street_address", "person_name")



def _ranges(of: Callable[[str], bool]) -> str:
    """Letters of Latin, Greek, Cyrillic and Armenian with a property, as ranges of a character class."""
    out: list[list[int]] = []
    for n in (*range(0x41, 0x588), *range(0x1E00, 0x2000)):
        if of(chr(n)) and chr(n).isalpha():
            if out and out[-1][1] == n - 1:
                out[-1][1] = n
            else:
                out.append([n, n])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


U, L = _ranges(str.isupper), _ranges(str.islower)
# What stands between the parts of numbers.
S = r"[     .\-‐-―−/]"
D = r"[     \-‐-―−]"

# Kinds of places, organisations, things and settings that follow a proper name without making it a person's.
THINGS = frozenset(
    """station valley court road street avenue drive lane square place board council team guild group committee department division server service cluster network system systems labs software inc ltd gmbh corp company university
    institute school hospital hotel bridge tower park hill river lake bay island city town county state mountain beach forest airport terminal version build edition release update patch project product platform suite studio cloud setting settings mode
    profile policy report review incident advisory branch freeze window period limit rule rules engine scanner console portal gateway framework library model protocol algorithm theorem award prize foundation bank museum""".split()
)
# Words that begin sentences or lines and are no surnames.
STARTERS = frozenset(
    """the this that these those a an and or but for from with without after before between both each every all no not nobody please if when while where what why how who which one two three add bind resolve replace run check look list show tell see
    confidence severity calibration mutation baseline duplicate rule release section serial order part pid peer matrix range retry order we i you he she it they there here cwe phone tel fax mail email contact subject note author signed reported reviewed
    according thanks deliver ask escalate returned anschrift der die das ein eine und nach den dem in im am zum zur la le les el los las un une une o os as um uma de du des il elle ce cette a e se si en por para con sin após après depois después quedan
    rückfragen antwort réponse responder tel tél correo courriel correio id adresse dirección morada wert befund regel datensatz zeile ligne linha fila unit flat suite apt apartment no nr mr mrs ms dr prof""".split()
)
TITLES = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam|Herrn?|Frau|Hr|Fr|Mme|Mlle|MM|Monsieur|Madame|Mademoiselle|Sr|Sra|Srta|Señor|Señora|Don|Doña|Dra|Eng|Ing|Dipl-Ing|Sig|Signor|Signora|Dott|Senhor|Senhora|Dona|Rev|Capt)"
TITLE_WORD = re.compile(TITLES)
PARTICLE = r"(?:von|van|vom|zu|de|del|della|di|da|das|do|dos|du|des|la|le|el|al|bin|ibn|ten|ter|den|der|af|av|y|e)"
CAP = rf"[{U}](?:['’][{U}])?[{L}]+(?:['’]?[{U}][{L}]+)?(?:-[{U}](?:['’][{U}])?[{L}]+(?:['’]?[{U}][{L}]+)?)*"
ALLCAPS = rf"(?:[{U}]['’])?[{U}]{{2,}}(?:-[{U}]{{2,}})*"
ANY = rf"(?:{CAP}|{ALLCAPS})"
INITIAL = rf"[{U}]\."
B = r"(?<![\w@./+-])(?<!\w['’])"
GAP = r"[    ]"

# surname part: particles and one or two capitalised words
SURNAME = rf"(?:(?:{PARTICLE}{GAP}){{0,2}}{ANY}(?:{GAP}(?:{PARTICLE}{GAP})?{ANY})?)"
NAME_FORWARD = re.compile(rf"{B}(?P<given>{ANY})(?P<mid>(?:{GAP}(?:{INITIAL}|{ANY}(?={GAP})))?{GAP})(?P<last>(?:{PARTICLE}{GAP}){{0,2}}{ANY}(?:{GAP}(?:(?:{PARTICLE}{GAP})?{ANY}))?)")
NAME_COMMA = re.compile(rf"{B}(?P<last>(?:{PARTICLE}{GAP}){{0,2}}{ANY}(?:{GAP}{ANY})?),{GAP}?(?P<given>{ANY}|{INITIAL})(?:{GAP}{INITIAL})?(?![\w@])")
NAME_CAPS = re.compile(rf"{B}(?P<last>(?:{PARTICLE}{GAP})?{ALLCAPS}(?:{GAP}{ALLCAPS})?){GAP}(?P<given>{CAP})(?![\w@])")
NAME_TITLE = re.compile(rf"{B}(?P<title>{TITLES})(?:\.|(?<=[a-zñ])(?={GAP})){GAP}?(?:(?:{TITLES})\.?{GAP})?(?P<name>(?:(?:{INITIAL}|{ANY}){GAP}?){{0,2}}{SURNAME}|{ANY},{GAP}(?:{ANY}|{INITIAL}))")
NAME_INITIAL = re.compile(rf"{B}(?P<given>{INITIAL}(?:{GAP}?{INITIAL})?){GAP}(?P<last>{SURNAME})(?![\w@])")
# Words and fields that introduce a person.
INTRODUCTIONS = re.compile(
    rf"(?:\b(?:[Aa]ssigned to|[Tt]hanks to|[Aa]ccording to|[Ii]nterview with|[Tt]alk with|[Mm]eeting with|[Cc]all with|[Ss]poke (?:to|with)|[Dd]eliver to|[Tt]icket of|[Ll]etter to|[Dd]ear|[Rr]egards,|"
    rf"[Gg]e[a-zü]+(?:t|en) von|[Rr]ücksprache mit|[Gg]espräch mit|[Ss]ignalé par|[Vv]érifié par|[Ee]ntretien avec|[Ii]nformado por|[Rr]evisado por|[Cc]onversación con|[Ee]ntrevista con|[Cc]omunicado por|[Rr]evisto por|[Cc]onversa com|[Ss]egnalato da)[ \u00a0]+|"
    rf"\b(?:cc|Cc|CC|Ask|by|By|attn:?|Attn:?|ATTN:?|z\. ?Hd\.)[ \u00a0]+|(?:[A-Z][a-z]+(?:-[a-z]+)*-by|[A-Z][a-z]{{2,}}|FN|CN)[ \u00a0]?:[ \u00a0]?|"
    rf"(?:owner|backup|assignee|name|reviewer|reporter|author|contact|full_?name|fullName|displayName|contact_name|customer_name)\"?\s?[=:]\s?[\"']?|@author[ \u00a0]+|TODO\(|FIXME\(|[Pp]assport \S+(?: \S+){{0,2}} of |\bVALUES \(\d+, '|\[[\"'])(?P<name>(?:(?:{INITIAL}|{ANY}){GAP}){{1,2}}{SURNAME})(?![\w@])"
)
# The same words prove nothing about what the name consists of unless they are one of these.
PROVING = re.compile(r"-by[ \u00a0]?:|\b[Aa]uthor|owner|assignee|reviewer|reporter|full_?name|fullName|displayName|contact_name|customer_name|FN|CN|[Dd]ear|TODO|FIXME|[a-z]+ed by|[Pp]assport|[Ii]nterview|[Ss]poke|[Gg]espräch|[Ee]ntretien|[Cc]onvers|[Ee]ntrevista")
NAME_MAIL = re.compile(rf"{B}(?P<name>(?:(?:{INITIAL}|{ANY}){GAP}){{1,2}}{SURNAME})\"?\s?[<(]\s?(?:mailto:)?[\w.+-]+@")
# What only persons do, and what stands before persons.
DOES = re.compile(
    r"[ \u00a0,]+(?:has |had |also |then |just |hat |a |ha |já |ya )?(?:said|says|wrote|writes|asked|asks|replied|told|thinks|thought|noted|notes|phoned|called|calls|met|joined|left|lives|works|worked|agreed|confirmed|confirms|reported|reports|reviewed|reviews|approved|signed|complained|suggested|explained|explains|noticed|"
    r"forwarded|offered|promised|apologi[sz]ed|resigned|sagte|schrieb|fragte|antwortete|meldete|bestätigte|prüfte|wohnt|arbeitet|bat|dit|écrit|demandé|répondu|confirmé|signalé|habite|travaille|dijo|escribió|preguntó|confirmó|informó|vive|trabaja|disse|escreveu|perguntou|confirmou|mora|trabalha|ha detto|ha scritto|abita|lavora)\b|'s (?:phone|number|address|mail|e-?mail|mother|father|wife|husband|manager|desk|laptop|passport|account)\b"
)
BEFORE_PERSON = re.compile(
    r"(?i)(?:\b(?:by|with|contact|ask|asked|told|met|thanks?|dear|hi|hello|from|cc|engineer|manager|developer|maintainer|reviewer|analyst|author|colleague|customer|patient|employee|director|nurse|teacher|professor|mit|von|bei|kollegin|kollege|herrn?|frau|avec|par|con|por|com|senhora?|colega|collègue)|[-–—•*,;:(\"'|])[ \u00a0]?$"
)
SPOKEN_TO = re.compile(r"(?i)\b(?:contact|ask|asked|told|met|thanks?|thank|dear|hi|hello|cc|phone|called|emailed|messaged|pinged|(?:talk|talked|spoke|speak|met|meet|chat|chatted|interview|sat|worked) with|spoke to|talked to|introduced|interviewed|hired|colleague|patient|customer|employee|kollegin|kollege|senhora?|señora?|colega|collègue)[ \u00a0]$")
BY = re.compile(r"(?i)\bby[ \u00a0]$")
# Endings that surnames of some languages have and few other words.
FAMILY = re.compile(
    r"(?i)(?:.{2,}(?:ski|ska|sky|skaya|cki|cka|wicz|vich|vych|czyk|czak|enko|chuk|czuk|yuk|sson|dottir|dóttir|escu|eanu|ović|ovic|ević|evic|oğlu|oglu|opoulos|opoulou|idis|idou|akis|aki|ashvili|shvili|adze|mann|stein|bauer|meyer|meier|huber|hofer|inski|quist|gren|ström|strom|lund|berg|dahl|"
    r"nen|ánek|ková|ova|eva|ina|ov|ev|yev|ian|yan|ández|ández|ález|ínez|érez|ernandez|onzalez|artinez|ópez|íguez|iguez|ães|eira|eiro|inho|etti|ucci|elli|ini|otti|accio|ов|ева|ев|ова|ин|ина|ский|ская|цкий|цкая|енко|чук|юк|ян|швили|дзе|όπουλος|οπούλου|ίδης|ίδου|άκης|άκη|ιάδης|ιάδου|έας)|(?:o|d|l)['’].{3,}|mc.{3,}|mac[A-Z].{2,}|fitz.{3,})$"
)
# Names in scripts without capitals: behind or before words that only go with persons.
OTHER_SCRIPT = re.compile(
    r"(?P<han>(?<![\u4e00-\u9fff])[\u4e00-\u9fff]{2,4}?)(?=(?:先生|女士|小姐|太太|博士|教授|经理|老师|さん|様|氏|君)(?![\u4e00-\u9fff]))"
    r"|(?:姓名|作者|报告人|联系人|负责人|审核人|提交人|客户|氏名|担当者?|報告者|名前|성명|이름|담당자?|작성자)[ \t]?[:：][ \t]?(?P<field>[\u4e00-\u9fff]{2,5}|[\uac00-\ud7a3]{2,4}|[\u3040-\u30ff\u4e00-\u9fff]{2,8})"
    r"|(?P<hangul>(?<![\uac00-\ud7a3])[\uac00-\ud7a3]{2,4})(?= ?(?:씨|님|선생님|대리|과장|부장)(?![\uac00-\ud7a3]))"
    r"|(?<![\u4e00-\u9fff])(?P<bare>[王李张張刘劉陈陳杨楊黄黃赵趙周吴吳徐孙孫马馬朱胡郭何高林罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾萧田董袁潘于蒋蔡余杜叶葉程苏蘇魏吕呂丁任沈姚卢盧姜崔钟譚谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤][\u4e00-\u9fff]{1,2})(?![\u4e00-\u9fff])"
    r"|(?:السيدة?|الدكتورة?|الأستاذة?|المهندسة?|الآنسة)[ ]+(?P<arabic>[\u0621-\u064a]{2,}(?: [\u0621-\u064a]{2,}){0,2})|(?:בתודה|מר|גברת|ד\"ר|פרופ')[ ]+(?P<hebrew>[\u05d0-\u05ea]{2,}(?: [\u05d0-\u05ea]{2,})?)"
)

EMAIL = re.compile(
    r"(?<![\w.+\-/@])(?P<local>[A-Za-z0-9À-ÿ](?:[\w.+'\-]{0,62}[\w+])?)(?P<at>\s?[\[({<]\s?(?:at|AT|At|@|ät|arroba|chez|bei)\s?[\])}>]\s?|@|＠|&#64;|&#x40;|&commat;|%40|\s(?:at|AT)\s(?=[\w-]+(?:\s(?:dot|DOT)\s|\s?[\[({<]\s?(?:dot|DOT)))|\s@\s(?=\w))"
    r"(?P<domain>[A-Za-z0-9À-ÿ](?:[\w-]{0,62})(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|punkt|punto|ponto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9À-ÿ][\w-]{0,62})*(?:\.|\s?[\[({<]\s?(?:dot|DOT|punkt|punto|ponto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)[A-Za-zÀ-ÿ]{2,24})(?![\w@-])"
)
AT = re.compile("@")
MAIL_WORDS = ("＠", "&#", "&commat", "%40", " at ", "[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at", "ät", "arroba", "chez", "bei")
MAIL_GATE = re.compile(r"＠|&#|&commat|%40|[\[({<] ?(?:at|AT|At|ät|arroba|chez|bei) ?[\])}>]| (?:at|AT) \S+ ?[\[({<]? ?(?:dot|DOT)")
NOT_MAILBOX_BEFORE = re.compile(r"(?:://[^\s@/]*|\b(?:ssh|scp|sftp|rsync|git clone|svn\+ssh|mosh|ssh-copy-id|psql|ftp|telnet|rlogin|su|login as)\s(?:-\w+\s\S*\s?|\S+\s)*)$")

EXTENSION = r"(?:\s?(?:x|ext\.?|extension|Durchwahl|Dw\.?|poste|ext)\s?\d{1,5})?"
G = r"(?<![\w+./\-‐-―:#])"
E = r"(?![\w])(?![.\-:/‐-―]\d)"
PHONES = (
    re.compile(rf"(?<![\w+./\-])(?P<n>\(?(?:\+|00)[1-9]\d{{0,2}}\)?(?:{S}{{0,3}}\(?\d{{1,12}}\)?){{1,7}}){EXTENSION}{E}"),
    re.compile(rf"{G}(?P<n>(?:1{S})?(?:\(\d{{3}}\){D}?|\d{{3}}{S})\d{{3}}{S}\d{{4}}){EXTENSION}{E}"),
    re.compile(rf"{G}(?P<n>\(?0[1-9]\d{{0,4}}\)?(?:{S}{{1,3}}\d{{2,9}}){{1,5}}){EXTENSION}{E}"),
    re.compile(rf"{G}(?P<n>\(\d{{2,4}}\){D}?9?\d{{3,5}}{D}\d{{3,4}}){EXTENSION}{E}"),
)
WEAK_PHONE = re.compile(rf"{G}(?P<n>\d{{2}}{S}\d{{4}}{S}\d{{4}}|[6-9]\d{{2}}{S}?\d{{3}}{S}?\d{{3}}|\d{{2,3}}{S}\d{{3}}{S}\d{{3}}|\d{{3}}(?:{S}\d{{2}}){{3}}|\d{{2}}{S}9\d{{4}}{S}\d{{4}}|0\d{{8,11}}|1?[2-9]\d{{9}}|\d{{3}}{S}\d{{4}}){EXTENSION}{E}")
PHONE_WORDS = re.compile(
    r"(?i)\b(?:tel|tél|tele?fone?|téléphone|teléfono|telefono|telefon|phone|mobile?|móvil|telemóvel|celular|handy|cell|fax|call(?:s|ed|back|ing)?|llame|llamar|ligue|ligar|appel\w*|anrufen|ruf|whatsapp|signal|hotline|sms|reach|dial|rufnummer|number|screenshot shows|escalate to)\b|_PHONE|\bTEL[;:]"
)
ID_STRONG = (
    re.compile(rf"{G}\d{{3}}(?P<s>{D})\d{{2}}(?P=s)\d{{4}}{E}"),
    re.compile(rf"(?<![\w-])[A-CEGHJ-PR-TW-Z]{{2}}{D}?\d{{2}}{D}?\d{{2}}{D}?\d{{2}}{D}?[A-D](?![\w-])"),
    re.compile(r"(?<![\w/.-])[A-Z]\d{8}(?![\w-])"),
    re.compile(rf"{G}\d{{8}}{D}?[A-HJ-NP-TV-Z](?![\w-])"),
    re.compile(rf"(?<![\w-])[XYZ]{D}?\d{{7}}{D}?[A-Z](?![\w-])"),
    re.compile(rf"{G}\d{{3}}\.\d{{3}}\.\d{{3}}[-‐-―]\d{{2}}{E}"),
    re.compile(rf"{G}\d{{2}}{D}\d{{3}}{D}\d{{3}}{D}\d{{3}}{E}"),
    re.compile(rf"{G}[12]{D}\d{{2}}{D}\d{{2}}{D}(?:\d{{2}}|2[AB]){D}\d{{3}}{D}\d{{3}}(?:{D}\d{{2}})?{E}"),
    re.compile(rf"{G}[12]\d{{2}}(?:0[1-9]|1[0-2]|[2-9]\d)(?:\d{{2}}|2[AB])\d{{6}}(?:\d{{2}})?{E}"),
    re.compile(rf"{G}\d{{11}}{E}"),
)
NOT_ADDRESS_BEFORE = re.compile(r"(?i)(?:section|chapter|page|item|line|rule|step|table|figure|version|release|build)\s$")
NOT_ID_BEFORE = re.compile(r"(?i)(?<![^\W\d_])(?:order|epoch|build|checksum|offset|serial(?: no)?|part(?: no)?|size|isbn[\w -]*|range|run|pid|tid|version|commit|hash|sha\d*|id=|ms|bytes|seq|timestamp|ts|nonce|port|amount|trace|request|job|ticket)\W{0,3}$")
ID_WORDS = r"(?:passports?|passport no\.?|reisepass\w*|passeport|pasaporte|passaporte|id[- ]card|ausweis\w*|identity (?:number|card)|carte d'identité|ssn|social security|national insurance|tax (?:id|number|no)|steuer-?(?:id|nummer)|identifikationsnummer|dni|nie|nif|nie|cpf|rg|bsn|pesel|codice fiscale|tin|ein|national id|nino|sécurité sociale|segurança social|seguridad social|contribuinte|personalausweis\w*)"
ID_HINTS = ("pass", "ident", "ausweis", "card", "ssn", "soci", "secur", "ségur", "segur", "national", "tax", "steuer", "dni", "nie", "nif", "cpf", "rg", "bsn", "pesel", "tin", "ein", "nino", "codice", "contrib")
ID_BY_WORD = re.compile(rf"(?i)\b{ID_WORDS}\b[^\w\n]{{0,4}}(?:(?:no|nr|number|num|n\.º|nº|n°|is|ist|est|es|é|on the form|of|:)[^\w\n]{{0,4}}){{0,3}}(?P<n>(?-i:[A-Z]{{0,3}}){D}?\d(?:[\d.\-/ ]{{3,18}}\d|\d{{4,16}})(?:{D}?(?-i:[A-Z]))?)(?![\w])")

TYPE_WORDS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Ter|Way|Close|Cl|Crescent|Cres|Gardens|Gdns|Row|Rise|Quay|Walk|Hill|Grove|Mews|Parade|Park|View|Yard|Wharf|Green|Alley|Circle|Cir|Trail|Trl|Highway|Hwy|Parkway|Pkwy|Path|Gate|Heights|Ridge|Loop|Turnpike|Esplanade|Vale|Meadow|Meadows"
UNIT = r"(?:(?:Flat|Suite|Ste\.?|Unit|Apt\.?|Apartment|Room|Floor|House|Building)\s#?\d{1,4}[A-Za-z]?,?\s)"
ADDRESS_EN = re.compile(
    rf"(?<![\w.\-/])(?:{UNIT})?(?:No\.?\s)?\d{{1,5}}(?:\s?[A-Da-d](?![\w.])|[-–]\d{{1,5}})?,?\s(?:(?:[NSEW]|NE|NW|SE|SW|North|South|East|West|St|Saint|Upper|Lower|Old|New|Great|Little)\.?\s)?(?:(?:\d{{1,3}}(?:st|nd|rd|th)|[{U}][\w'’-]*)\s){{1,3}}?(?:{TYPE_WORDS})\b\.?",
)
ADDRESS_EN_CAPS = re.compile(rf"(?<![\w.\-/])(?:NO\.?\s)?\d{{1,5}}(?:[A-D]|[-–]\d{{1,5}})?\s(?:(?:[{U}'’]+|\d{{1,3}}(?:ST|ND|RD|TH))\.?\s){{1,3}}?(?:{TYPE_WORDS.upper()})\b\.?")
NUMBER_AFTER = r"\d{1,4}(?:\s?[a-h](?!\w))?(?:\s?[-–/]\s?\d{1,4}[a-h]?)?"
ADDRESS_DE = re.compile(
    rf"(?<![\w-])(?:(?:[{U}][{L}]+(?:[- ])){{0,2}}(?:[{U}][{L}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|graben|grund|berg|steig|pfad|hof|markt|chaussee|wall|tor|feld|wiese|park|brücke|furt|stieg|kamp|garten|promenade|winkel|twiete)|(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm))|"
    rf"(?:Am|An der|An den|An dem|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Unter der|Vor dem|Hinter der|Bei der|Beim)\s[{U}][{L}]+(?:[- ][{U}][{L}]+)?)\s{NUMBER_AFTER}(?![\w.]*\d)"
)
ADDRESS_FR = re.compile(
    r"(?<![\w.\-/])\d{1,4}(?:\s?(?:bis|ter|quater|[A-D]))?,?[ \u00a0](?i:rue|avenue|av\.|ave|boulevard|bd\.?|blvd|place|pl\.|chemin|ch\.|impasse|imp\.|allée|all\.|quai|cours|route|rte\.?|square|passage|ruelle|sentier|faubourg|fbg|esplanade|rond-point|montée|côte|voie|villa|cité|résidence)[ \u00a0](?:(?:de la|de l['’]|des|du|de|d['’]|aux|au|à la|à l['’]|la|le|les|l['’])[ \u00a0]?)?[\wÀ-ÿ][\w'’À-ÿ-]*(?:[ \u00a0][A-ZÀ-Þ][\w'’À-ÿ-]*)*",
)
ADDRESS_IBERIAN = re.compile(
    rf"(?<![\w])(?:Calle|C/|Cl\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Plz\.|Paseo|P\.º|Pº|Camino|Cno\.|Carretera|Ctra\.|Ronda|Travesía|Trv\.|Cuesta|Glorieta|Rambla|Vía|Callejón|Rua|R\.|Travessa|Tv\.|Largo|Lg\.|Praça|Pç\.|Alameda|Al\.|Estrada|Estr\.|Calçada|Beco|Rotunda|Via|Viale|Piazza|Corso|Vicolo)\s"
    rf"(?:(?:de la|de las|de los|del|de|da|do|das|dos|di|della|dei|el|la|los|las|a|o)\s)?[{U}][\w'’-]*(?:\s(?:(?:de la|de las|de los|del|de|da|do|das|dos|y|e)\s)?[{U}][\w'’-]*){{0,3}},?\s?(?:(?:n\.?\s?[º°o]\.?|núm\.?|nr\.?|No\.?)\s?)?\d{{1,4}}(?:\s?[A-Za-z](?!\w))?(?![\w-]*\d)"
)
TOWN = re.compile(rf"(?:[ \u00a0]?[,;]|[ \u00a0][-–])[ \u00a0]?(?:(?:\d+[ \u00a0]?º[ \u00a0]?(?:[A-Z]|izda|dcha|esq|dto)\.?)(?:[ \u00a0]?[,;]|[ \u00a0][-–])?[ \u00a0]?)?(?:\d{{4,5}}(?:-\d{{3}})?[ \u00a0][{U}][\w'’-]+(?:[ \u00a0][{U}][\w'’-]+)?|[{U}][\w'’-]+(?:[ \u00a0][{U}][\w'’-]+)?[ \u00a0](?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ \u00a0]?\d[A-Z]{{2}}|\d{{4,5}}(?:-\d{{4}})?))(?!\w)")


BLANK = re.compile(r"\s")
# Places that these do not meet have no name, number or address, and are not looked at further.
OF = rf"(?:{PARTICLE}{GAP}(?:{PARTICLE}{GAP})?)?"
OTHER_LETTERS = re.compile(r"[\u0590-\u06ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]{2}")
NAME_GATE = re.compile(rf"[{U}][\w'’.-]*(?:,?{GAP}{{1,2}}|(?<=\.)){OF}[{U}]")
NUMBER_GATE = re.compile(r"\d(?:[^\w\n]{0,3}\d|[A-D]\b){5,}")
ADDRESS_GATE = re.compile(rf"\d[\w-]{{0,8}},?[ \u00a0](?:[{U}\d]|bis|ter|rue|av|bou|bd|bl|pl|ch|im|al|qu|co|ro|rt|sq|pa|ru|se|fa|es|mo|cô|vo|vi|ci|ré)|[{U}][\w'’.-]*,?[ \u00a0](?:n\S{{1,3}}[ \u00a0]?)?\d")


@dataclass(frozen=True, order=True)
class Item:
    """A piece of personal information: its place and type."""

    start: int
    end: int
    kind: str


class Spans:
    """Places that are taken, in order, none inside another."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return not at or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> None:
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, max(b, self.ends[at - 1] if at else 0))


def _regions(text: str, gate: re.Pattern, before: int, after: int) -> list[tuple[int, int, int, int]]:
    """Where `gate` meets `text`, with some of the line around: line's begin and end, region's begin and end.

    Regions that touch are one, and none ends inside a word, so whatever the gate meets all along is never cut.
    """
    out: list[list[int]] = []
    for m in gate.finditer(text):
        a, b = m.span()
        if out and a - before <= out[-1][3] and a < out[-1][1]:
            last = out[-1]
            if b + after > last[3]:
                last[3] = _word_end(text, b + after, last[1])
            continue
        begin = text.rfind("\n", 0, a) + 1
        end = text.find("\n", b)
        end = len(text) if end < 0 else end
        out.append([begin, end, max(begin, a - before), _word_end(text, b + after, end)])
    return [tuple(r) for r in out]


def _word_end(text: str, at: int, end: int) -> int:
    if at >= end:
        return end
    m = BLANK.search(text, at, end)
    return m.start() if m else end


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words that a public tokenizer's vocabulary has in lower case, and those it has only with a capital; none where the file is missing."""
    if not Path(path).exists():
        return frozenset(), frozenset()
    tokens = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    # a leading \u0120 is how such files write the blank before a word
    words = {t[1:] for t in tokens if t[0] == "\u0120" and len(t) > 3 and t[1:].isalpha()}
    low = frozenset(w for w in words if w.islower())
    return low, frozenset(w.lower() for w in words if w[0].isupper() and w[1:].islower() and w.lower() not in low)


@dataclass(frozen=True)
class Words:
    """What is known of words beforehand: ordinary ones and proper names of any kind, from a public vocabulary."""

    path: str = f"{TOKENIZERS}/byte_bpe_50k.json"

    def common(self, word: str) -> bool:
        return word.lower() in _vocabulary(self.path)[0]

    def proper(self, word: str) -> bool:
        return word.lower() in _vocabulary(self.path)[1]


def _is_surname(text: str) -> bool:
    words = [w for w in re.split(GAP, text) if not re.fullmatch(PARTICLE, w)]
    return bool(words) and all(len(w) > 1 for w in words) and words[0].lower() not in THINGS and words[0].lower() not in STARTERS and words[-1].lower() not in THINGS


def _trim_last(text: str, last: str) -> str:
    """A surname of one word where the second word begins something else."""
    words = last.split(" ")
    while len(words) > 1 and (words[-1].lower() in STARTERS or words[-1].lower() in THINGS and words[0].lower() not in THINGS or re.fullmatch(PARTICLE, words[-1])):
        words.pop()
    return " ".join(words)


@dataclass(frozen=True, order=True)
class Candidate:
    """Capitalised words that may be a person's name; `grade` tells what else must be known.

    0: the surname or the sentence speaks for a person. 1: given name or surname must be one in the corpus. 2: the surname is an
    ordinary word, so both must be. 3: nothing but both will do, as the first word is an ordinary one too.
    """

    start: int
    end: int
    given: str
    last: str
    grade: int


@dataclass
class Scan:
    """Items of one text, names in doubt, and what the text proves of words: (word, 'given' or 'last')."""

    items: list[Item]
    doubtful: list[Candidate]
    proven: set[tuple[str, str]]


def _plain_words(name: str) -> list[str]:
    return [w for w in re.split(rf"{GAP}|,", name) if len(w) > 2 and not re.fullmatch(PARTICLE, w) and not TITLE_WORD.fullmatch(w)]


def _key(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def _names(text: str, taken: Spans, line: int, end: int, start: int, stop: int, words: Words, scan: Scan, mailboxes: set[str]) -> None:
    """Names from `start` to `stop` of the line from `line` to `end`."""
    found: list[Item] = []

    def add(a: int, b: int) -> None:
        if taken.free(a, b):
            found.append(Item(a, b, "person_name"))

    def prove(name: str, reverse: bool = False) -> None:
        parts = _plain_words(name)
        if reverse:
            parts = parts[1:] + parts[:1]
        if parts and not any(p.lower() in STARTERS or p.lower() in THINGS for p in parts):
            scan.proven.add((_key(parts[-1]), "last"))
            if len(parts) > 1:
                scan.proven.add((_key(parts[0]), "given"))

    for m in NAME_TITLE.finditer(text, start, stop):
        name = m.group("name")
        if "," not in name:
            name = _trim_last(text, name)
        first = re.split(rf"{GAP}|,", name)[0]
        if first.lower() in STARTERS or first.lower() in THINGS or text[max(0, m.start() - 4) : m.start()].rstrip().endswith(("№", "No")):
            continue
        if m.group("title") == "Dr" and re.search(r"\d[A-D]?(?:-\d+)?\s(?:[\w'’.-]+\s){1,3}$", text[max(0, m.start() - 40) : m.start()]):
            continue
        add(m.start(), m.start("name") + len(name))
        prove(name, "," in name)
    for m in NAME_MAIL.finditer(text, start, stop):
        name = m.group("name")
        if not any(w.lower() in STARTERS or w.lower() in THINGS for w in name.split(" ")):
            add(m.start("name"), m.end("name"))
            prove(name)
    for m in NAME_INITIAL.finditer(text, start, stop):
        last = _trim_last(text, m.group("last"))
        if _is_surname(last) and not re.search(r"(?:\b[Nn]o|\b[Nn]r|\d|\b[Ss]ection|\b[Aa]ppendix|\b[Rr]ule|\b[Cc]lass)\s?$", text[max(0, m.start() - 12) : m.start()]):
            add(m.start(), m.start("last") + len(last))
            prove(last)
    for m in INTRODUCTIONS.finditer(text, start, stop):
        name = _trim_last(text, m.group("name"))
        parts = name.split(" ")
        if len(parts) < 2 or any(w.lower() in STARTERS or w.lower() in THINGS for w in parts if not re.fullmatch(PARTICLE, w)) or all(w.isupper() and len(w) < 5 for w in parts):
            continue
        if PROVING.search(text, max(line, m.start() - 16), m.start("name")) and not (words.common(parts[-1]) and words.common(parts[0])):
            add(m.start("name"), m.start("name") + len(name))
            prove(name)
        else:
            _weigh(text, m.start("name"), m.start("name") + len(name), parts[0], parts[-1], line, end, taken, words, scan, mailboxes)
    for m in NAME_COMMA.finditer(text, start, stop):
        given, last = m.group("given"), m.group("last")
        parts = last.split(" ")
        while len(parts) > 1 and (parts[0].lower() in STARTERS or parts[0].lower() in ("by", "to", "with")):
            parts = parts[1:]
        kept = " ".join(parts)
        if not _is_surname(kept) or given.lower() in STARTERS or given.lower() in THINGS:
            continue
        a = m.start() + len(last) - len(kept)
        if len(given) > 2:
            _weigh(text, a, m.end(), given, parts[-1], line, end, taken, words, scan, mailboxes, reverse=True)
        elif parts[-1].lower() not in STARTERS and not re.match(rf"{GAP}[{U}]", text[m.end() : m.end() + 2]):
            add(a, m.end())
            prove(kept)
    for m in NAME_CAPS.finditer(text, start, stop):
        if _is_surname(m.group("last")) and m.group("given").lower() not in STARTERS and m.group("given").lower() not in THINGS:
            _weigh(text, m.start(), m.end(), m.group("given"), m.group("last").split(" ")[-1], line, end, taken, words, scan, mailboxes, reverse=True)
    at = start
    while m := NAME_FORWARD.search(text, at, stop):
        given = m.group("given")
        at = m.start() + len(given)
        if given.lower() in STARTERS or given.lower() in THINGS:
            continue
        last = _trim_last(text, m.group("last"))
        mid = m.group("mid").strip()
        if not _is_surname(last) or mid and not mid.endswith(".") and (mid.lower() in THINGS or mid.lower() in STARTERS):
            continue
        until = m.start("last") + len(last)
        if _weigh(text, m.start(), until, given, last.split(" ")[-1], line, end, taken, words, scan, mailboxes):
            at = until
    found.sort(key=lambda i: (i.start, -i.end))
    out: list[Item] = []
    for item in found:
        if not out or item.start >= out[-1].end:
            out.append(item)
        elif item.end > out[-1].end and item.start == out[-1].start:
            out[-1] = item
    scan.items += out
    for item in out:
        taken.add(item.start, item.end)


def _weigh(text: str, a: int, b: int, given: str, last: str, start: int, stop: int, taken: Spans, words: Words, scan: Scan, mailboxes: set[str], *, reverse: bool = False) -> bool:
    """Notes a possible name with what is needed for it; whether it is one in any case of a known given name."""
    g, s = _key(given), _key(last)
    common, plain = words.common(last), words.common(given)
    if f"{g}.{s}" in mailboxes or f"{g}{s}" in mailboxes or f"{g[:1]}.{s}" in mailboxes or f"{g[:1]}{s}" in mailboxes:
        scan.proven |= {(g, "given"), (s, "last")}
        grade = 0
    elif FAMILY.match(last) and not common and not plain and not FAMILY.match(given) and not last.isupper():
        grade = 0
    elif not reverse and not common and not plain and given[1:].islower() and last[1:].islower() and not words.proper(last) and (DOES.match(text, b, stop) or BEFORE_PERSON.search(text[max(start, a - 24) : a]) and words.proper(given) or given.isascii() is False and DOES.match(text, b, stop)):
        grade = 0
    elif not reverse and not plain and not (common and not words.proper(given)) and given[1:].islower() and last[1:].islower() and SPOKEN_TO.search(text[max(start, a - 24) : a]):
        grade = 0
    elif not (reverse or common or plain or words.proper(last) or text[start:a].strip() or text[b:stop].strip(" ,\u00a0\r")):
        grade = 0  # a signature: a line of its own
    elif not reverse and words.proper(given) and DOES.match(text, b, stop):
        grade = 0
    elif not common and not plain and (last.isupper() and len(last) > 4 and (reverse and not given.isupper() or words.proper(given) or given.isupper() and len(given) > 3) or reverse and BY.search(text[max(start, a - 4) : a])):
        grade = 0
    elif plain:
        grade = 3
    else:
        grade = 2 if common else 1
    if not grade:
        scan.proven |= {(g, "given"), (s, "last")}
    scan.doubtful.append(Candidate(a, b, g, s, grade))
    return grade <= 1 and words.proper(given)


def _numbers(text: str, line: int, start: int, stop: int, take: Callable[[int, int, str], None], taken: Spans, named: bool) -> None:
    """Identity and telephone numbers from `start` to `stop` of the line that begins at `line`; those of plainer form come first."""
    for pattern in ID_STRONG:
        for m in pattern.finditer(text, start, stop):
            if taken.free(*m.span()) and not NOT_ID_BEFORE.search(text, max(line, m.start() - 16), m.start()):
                take(*m.span(), "id_number")
    for m in ID_BY_WORD.finditer(text, start, stop) if named else ():
        if 6 <= _digits(m.group("n")) <= 15 and taken.free(*m.span("n")) and not re.match(r"\d{4}-\d\d-\d\d$", m.group("n")):
            take(*m.span("n"), "id_number")
    for pattern in PHONES:
        for m in pattern.finditer(text, start, stop):
            a, b = m.span()
            if not 9 <= _digits(m.group("n")) <= 16 or not taken.free(a, b) or NOT_ID_BEFORE.search(text, max(line, a - 16), a) or re.search(r"\d{4}-\d\d-\d\d$", m.group("n")):
                continue
            if m.group("n").count("(") < m.group("n").count(")") and text[b - 1] == ")":
                b -= 1  # the bracket around the whole
            take(a, b, "phone")
    for m in WEAK_PHONE.finditer(text, start, stop):
        a, b = m.span()
        if not taken.free(a, b) or NOT_ID_BEFORE.search(text, max(line, a - 16), a):
            continue
        before = text[max(line, a - 48) : a]
        cell = re.search(r"[|\"';]\s?$", before) and re.match(r"\s?(?:[|;,\"')\]\r\n]|$)", text[b : b + 2])
        if PHONE_WORDS.search(before) or (cell and _digits(m.group("n")) >= 8 and re.search(S, m.group("n"))):
            take(a, b, "phone")


def scan_text(text: str | None, words: Words = Words()) -> Scan:
    """What `text` has for certain and what depends on the rest of the corpus."""
    scan = Scan([], [], set())
    if not text:
        return scan
    taken = Spans()
    mailboxes: set[str] = set()

    def take(a: int, b: int, kind: str) -> None:
        scan.items.append(Item(a, b, kind))
        taken.add(a, b)

    low = text.lower()
    spelled = any(w in low for w in MAIL_WORDS) and MAIL_GATE.search(text) is not None
    places = [(0, len(text))] if spelled else [(a, b) for _, _, a, b in _regions(text, AT, 96, 160)] if "@" in text else []
    for a, b in places:
        for m in EMAIL.finditer(text, a, b):
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            after = text[m.end() : m.end() + 2]
            if NOT_MAILBOX_BEFORE.search(line) or after[:1] == ":" and after[1:2] not in ("", " ", "\n", "\r", '"') or after[:1] == "/":
                taken.add(m.start(), m.end())
                continue
            if m.group("at") in (" @ ",) and not m.group("domain").islower():
                continue
            take(m.start(), m.end(), "email")
            mailboxes.add(re.sub(r"[_-]", ".", _key(m.group("local"))))
    named = any(w in low for w in ID_HINTS)
    for line, _, start, stop in _regions(text, NUMBER_GATE, 96, 40):
        _numbers(text, line, start, stop, take, taken, named)
    for _, _, start, stop in _regions(text, ADDRESS_GATE, 96, 160):
        for pattern in (ADDRESS_EN, ADDRESS_EN_CAPS, ADDRESS_FR, ADDRESS_DE, ADDRESS_IBERIAN):
            for m in pattern.finditer(text, start, stop):
                a, b = m.span()
                if not taken.free(a, b) or NOT_ADDRESS_BEFORE.search(text, max(0, a - 12), a):
                    continue
                if town := TOWN.match(text, b, stop):
                    b = town.end()
                take(a, b, "street_address")
    other_script = not text.isascii() and OTHER_LETTERS.search(text) is not None
    for line, end, start, stop in _regions(text, NAME_GATE, 64, 80):
        _names(text, taken, line, end, start, stop, words, scan, mailboxes)
    if other_script:
        for m in OTHER_SCRIPT.finditer(text):
            a, b = m.span(m.lastgroup)
            if taken.free(a, b):
                take(a, b, "person_name")
    scan.items.sort()
    scan.doubtful = [c for c in sorted(set(scan.doubtful), key=lambda c: (c.start, -c.end)) if taken.free(c.start, c.end)]
    return scan


def is_name(grade: int, given_known: bool, last_known: bool) -> bool:
    """Whether a candidate counts, once the corpus has told whether its words are a given name and a surname."""
    return grade == 0 or grade == 1 and (given_known or last_known) or given_known and last_known


def chosen(items: list[Item], names: list[Candidate]) -> list[Item]:
    """Items with the candidates that count, in order, none inside another."""
    out: list[Item] = []
    for i in sorted([*items, *(Item(c.start, c.end, "person_name") for c in names)], key=lambda i: (i.start, -i.end)):
        if not out or i.start >= out[-1].end:
            out.append(i)
    return out


def find_pii(text: str | None, words: Words = Words(), proven: set[tuple[str, str]] = frozenset()) -> list[Item]:
    """The items in `text`, in order, none inside another. `proven` is what other texts say of words; the text's own is added."""
    scan = scan_text(text, words)
    known = scan.proven | set(proven)
    return chosen(scan.items, [c for c in scan.doubtful if is_name(c.grade, (c.given, "given") in known, (c.last, "last") in known)])


def lines_of(text: str, items: list[Item]) -> list[tuple[int, str]]:
    """Line and type of each item, each pair once."""
    return sorted({(text.count("\n", 0, i.start) + 1, i.kind) for i in items})


def canonical(kind: str, text: str) -> str:
    """The form in which two mentions of one item are equal."""
    plain = unicodedata.normalize("NFKC", text).casefold()
    if kind == "email":
        return re.sub(r"\s|[\[({<>})\]]", "", re.sub(r"(?:\s|[\[({<])+(?:dot|punkt|punto|ponto|point)(?:\s|[\])}>])+", ".", re.sub(r"(?:\s|[\[({<])+(?:at|arroba|ät)(?:\s|[\])}>])+|&#64;|%40", "@", plain)))
    if kind in ("phone", "id_number"):
        return re.sub(r"^(?:00)", "+", re.sub(r"[^\w+]", "", plain))
    if kind == "person_name":
        if "," in plain:
            last, _, first = plain.partition(",")
            plain = f"{first} {last}"
        return " ".join(w for w in re.findall(r"[^\W\d_]+", plain) if len(w) > 1 and not TITLE_WORD.fullmatch(w.capitalize()))
    return " ".join(re.findall(r"\w+", plain))


def placeholders(text: str, items: list[Item]) -> str:
    """`text` with each item replaced by [TYPE_n]; equal items of a text have the same n."""
    numbers: dict[tuple[str, str], int] = {}
    per_kind: dict[str, int] = {}
    out, at = [], 0
    for i in items:
        known = (i.kind, canonical(i.kind, text[i.start : i.end]))
        if known not in numbers:
            per_kind[i.kind] = numbers[known] = per_kind.get(i.kind, 0) + 1
        out += [text[at : i.start], f"[{i.kind.upper()}_{numbers[known]}]"]
        at = i.end
    return "".join([*out, text[at:]])


# Letters that may stand for each other, so that a surrogate keeps sound, accents and script.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äëïöü", "âêîôû", "ãõ", "ąę", "ćńśźżł", "čďěňřšťžů", "çşğ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "אבגדהוזחטיכלמנסעפצקרשת", "0123456789")
#: The same for scripts of many letters, by their ranges.
SCRIPT_RANGES = ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
KEPT_WORDS = re.compile(rf"(?i){TYPE_WORDS}|{PARTICLE}|{TITLES}|flat|suite|unit|apartment|rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route|square|calle|avda|plaza|paseo|camino|ronda|travesía|rua|largo|praça|alameda|estrada|travessa|beco|izda|dcha|straße|strasse|weg|gasse|platz|allee|ring|ufer|damm")
ROUNDS = 6


@lru_cache(maxsize=70_000)
def _place(c: str) -> tuple[str | int, int, int]:
    """The alphabet of a lower-case letter or digit (text or first code point), its place in it and the size; size 1 for letters that stay."""
    for letters in ALPHABETS:
        if c in letters:
            return letters, letters.index(c), len(letters)
    n = ord(c)
    for a, b in SCRIPT_RANGES:
        if a <= n < b:
            return a, n - a, b - a
    return c, 0, 1


def _letter(alphabet: str | int, at: int) -> str:
    return chr(alphabet + at) if isinstance(alphabet, int) else alphabet[at]


def permuted(text: str, key: bytes, kind: str, *, keep_last_vowel: bool = False) -> str:
    """`text` with its letters and digits replaced under `key`: a permutation of all texts of its form without fixed points.

    The first letter depends on the first letter alone, the others on all of them, each keeping its case and alphabet.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = [_place(c) for c in low]
    free = [i for i, p in enumerate(places) if p[2] > 1]
    if not free:
        return text
    if keep_last_vowel and len(free) > 2 and free[-1] == len(low) - 1 and low[-1] in "aeioауяоеαηος":
        free.pop()
    at = {i: places[i][1] for i in free}
    first, rest = free[0], free[1:]
    alphabet, _, size = places[first]
    own = f"{kind}\x1f{alphabet}".encode()
    tweak = f"{kind}\x1f{low[first]}\x1f{''.join('.' if i in at else c for i, c in enumerate(low))}".encode()
    at[first] = (at[first] + 1 + int.from_bytes(hashlib.blake2b(own, key=key).digest()[:4], "big") % (size - 1)) % size
    halves = (rest[: len(rest) // 2], rest[len(rest) // 2 :])
    for r in range(ROUNDS):
        into, out_of = halves[r % 2], halves[1 - r % 2]
        if into:
            said = ",".join(str(at[i]) for i in out_of).encode()
            noise = hashlib.shake_128(b"\x1f".join((key, tweak, bytes([r]), said))).digest(4 * len(into))
            for n, i in enumerate(into):
                at[i] = (at[i] + int.from_bytes(noise[4 * n : 4 * n + 4], "big")) % places[i][2]
    new = [_letter(places[i][0], at[i]) if i in at else low[i] for i in range(len(low))]
    return "".join(n.upper() if c.isupper() else n for n, c in zip(new, text, strict=True))


def gender_of(word: str) -> str | None:
    """The gender that the ending of a given name suggests, which surrogates keep: 'f', 'm', or None where it says nothing."""
    low = _key(word)
    return "f" if low[-1:] in ("a", "я", "а", "α", "η") else "m" if low[-1:] in ("o", "ο", "ς", "й") else None


def surrogate(kind: str, text: str, key: bytes) -> str:
    """A replacement for one item: same type, same format, different for different items."""
    key = key[:64]
    name_word = lambda m: m.group() if TITLE_WORD.fullmatch(m.group()) or re.fullmatch(PARTICLE, m.group()) else permuted(m.group(), key, "name", keep_last_vowel=True)
    if kind == "email":
        m = EMAIL.search(text)
        local, at, domain = (m.group("local"), m.group("at"), m.group("domain")) if m else (text, "", "")
        words = lambda part: re.sub(r"[^\W\d_]+", name_word, re.sub(r"\d+", lambda d: permuted(d.group(), key, "digits"), part))
        dots = r"\.|\s?[\[({<]\s?(?:dot|DOT|punkt|punto|ponto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s"
        pieces = re.split(f"({dots})", domain)
        dot = next((x for x in pieces[1::2]), ".")
        ending = "EXAMPLE" if domain.isupper() else "example"
        return words(local) + at + "".join(x if i % 2 else permuted(x, key, "domain") for i, x in enumerate(pieces)) + (dot + ending if domain else "")
    if kind in ("phone", "id_number"):
        # the country code stays, and two digits of it whatever its length, so that all ways of writing a number agree
        fixed = re.match(r"\(?(?:\+|00)\d\D?\d?", text) if kind == "phone" else None
        keep = fixed.end() if fixed else 0
        signs = [(i, c) for i, c in enumerate(text) if i >= keep and c.isalnum() and (kind == "id_number" or c.isdigit())]
        new = dict(zip((i for i, _ in signs), permuted("".join(c for _, c in signs), key, kind), strict=True))
        return "".join(new.get(i, c) for i, c in enumerate(text))
    if kind == "street_address":
        word = lambda m: m.group() if len(m.group()) < 4 or KEPT_WORDS.fullmatch(m.group()) else permuted(m.group(), key, "street")
        return re.sub(r"[^\W\d_]+", word, re.sub(r"\d+", lambda m: permuted(m.group(), key, "number"), text))
    return re.sub(r"[^\W\d_]+", name_word, text)


def surrogates(text: str, items: list[Item], key: bytes) -> str:
    """`text` with each item replaced by its surrogate."""
    out, at = [], 0
    for i in items:
        out += [text[at : i.start], surrogate(i.kind, text[i.start : i.end], key)]
        at = i.end
    return "".join([*out, text[at:]])


SPAN = "struct<start:int,stop:int,line:int,kind:string>"
DOUBT = "struct<start:int,stop:int,line:int,given:string,last:string,grade:int>"


def _scanned(documents: DataFrame, words: Words, *, texts: bool) -> DataFrame:
    """One row a document: row, doc_id, items, doubtful, proven (and its text)."""
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")))

    def run(columns: dict) -> dict:
        items, doubtful, proven = [], [], []
        for t in columns["t"]:
            scan = scan_text(t, words)
            line = _line_counter(t or "")
            items.append([(i.start, i.end, line(i.start), i.kind) for i in scan.items])
            doubtful.append([(c.start, c.end, line(c.start), c.given, c.last, c.grade) for c in scan.doubtful])
            proven.append([f"{role[0]}:{word}" for word, role in sorted(scan.proven)])
        fields = lambda kinds: pa.list_(pa.struct(kinds))
        place = [("start", pa.int32()), ("stop", pa.int32()), ("line", pa.int32())]
        structs = lambda rows, kinds: pa.array([[dict(zip((k for k, _ in kinds), r, strict=True)) for r in of] for of in rows], fields(kinds))
        out = {"doc_id": pa.array(columns["i"], pa.int64()), "items": structs(items, [*place, ("kind", pa.string())]), "doubtful": structs(doubtful, [*place, ("given", pa.string()), ("last", pa.string()), ("grade", pa.int32())]), "proven": pa.array(proven, pa.list_(pa.string()))}
        return out | ({"text": pa.array(columns["t"], pa.string())} if texts else {})

    schema = f"doc_id long, items array<{SPAN}>, doubtful array<{DOUBT}>, proven array<string>" + (", text string" if texts else "")
    # read twice, for what the corpus proves and for the items; the number of a row is the same for both
    return cut(map_columns(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))


def _line_counter(text: str) -> Callable[[int], int]:
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(breaks, at) + 1


def _settled(scanned: DataFrame) -> DataFrame:
    """row, doc_id, start, stop, line of the candidates that count, by what the whole corpus proves of their words."""
    proven = scanned.select(F.explode("proven").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("w")
    doubt = scanned.select("row", "doc_id", F.explode("doubtful").alias("c")).select("row", "doc_id", "c.*")
    at_once = doubt.where("grade = 0").select("row", "doc_id", "start", "stop", "line")
    # pairs of words once, however often they are written
    pairs = doubt.where("grade > 0").groupBy("given", "last").agg(F.min("grade").alias("least"))
    givens = proven.where(F.col("w").startswith("g:")).select(F.substring("w", 3, 1 << 20).alias("g_word"))
    lasts = proven.where(F.col("w").startswith("l:")).select(F.substring("w", 3, 1 << 20).alias("l_word"))
    known = pairs.join(givens, F.col("given") == F.col("g_word"), "left").join(lasts, F.col("last") == F.col("l_word"), "left")
    known = known.where(F.col("g_word").isNotNull() | F.col("l_word").isNotNull()).select(F.col("given").alias("k_given"), F.col("last").alias("k_last"), (F.col("g_word").isNotNull() & F.col("l_word").isNotNull()).alias("both"))
    counted = doubt.where("grade > 0").join(known, (F.col("given") == F.col("k_given")) & (F.col("last") == F.col("k_last"))).where((F.col("grade") == 1) | F.col("both"))
    return at_once.unionByName(counted.select("row", "doc_id", "start", "stop", "line"))


def find_personal(documents: DataFrame, *, words: Words = Words()) -> DataFrame:
    """doc_id, line_no, pii_type of each line of a text on which an item of the type begins.

    Lines end with a line feed, the first is 1. Null and empty texts have none; copies under other ids each come
    out. Texts are read whole.
    """

    scanned = _scanned(documents, words, texts=False)
    certain = scanned.select("row", "doc_id", F.explode("items").alias("i")).select("row", "doc_id", F.col("i.line").alias("line_no"), F.col("i.kind").alias("pii_type"))
    names = _settled(scanned).select("row", "doc_id", F.col("line").alias("line_no"), F.lit("person_name").alias("pii_type"))
    return certain.unionByName(names).distinct().drop("row")


def replace_personal(documents: DataFrame, *, key: str = "weftline", words: Words = Words()) -> DataFrame:
    """doc_id, masked, pseudonymous, items: each text with typed placeholders, with surrogates, and its number of items.

    Every document comes out; null texts stay null. `key` decides the surrogates and belongs in a secret store.
    """
    secret = hashlib.blake2b(key.encode()).digest()
    scanned = _scanned(documents, words, texts=True)
    names = _settled(scanned).groupBy(F.col("row").alias("n_row")).agg(F.collect_list(F.struct("start", "stop")).alias("names"))
    whole = scanned.select("row", "doc_id", "text", "items").join(names, F.col("row") == F.col("n_row"), "left").select("doc_id", "text", "items", "names")

    def run(columns: dict) -> dict:
        masked, named, counts = [], [], []
        for t, own, more in zip(columns["text"], columns["items"], columns["names"], strict=True):
            items = chosen([Item(i["start"], i["stop"], i["kind"]) for i in own or []], [Candidate(c["start"], c["stop"], "", "", 0) for c in more or []])
            masked.append(placeholders(t, items) if items else t)
            named.append(surrogates(t, items, secret) if items else t)
            counts.append(len(items))
        return {"doc_id": pa.array(columns["doc_id"], pa.int64()), "masked": pa.array(masked, pa.string()), "pseudonymous": pa.array(named, pa.string()), "items": pa.array(counts, pa.int32())}

    return map_columns(whole, run, "doc_id long, masked string, pseudonymous string, items int")
