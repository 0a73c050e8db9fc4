"""Problem 10: personal information in free text.

Regular expressions propose spans, validators (Luhn, mod 97, mod 11) and the words around adjust their scores, and spans
above ``ACCEPT`` are kept, the better one where two overlap. Names have no form of their own: words that tell of a person
(introductions, closings, roles, titles, verbs of writing, sending and living, in 13 languages) and neighbouring mail and
postal addresses propose the capitalised words beside them, and add to their score as the name's form does; words for
things and places take from it. Where a name is followed by the next sentence without a mark, it ends at the first word
that the documents write small too; those words are counted over all documents and travel as a filter of fixed size. A
name found once is found everywhere in its document.

Defined results: null and empty texts hold nothing; offsets are half-open code points of the text as it is; ISBNs, shelf and
catalogue numbers, DOIs, coordinates, prices, versions and year ranges are no cases.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.5
TYPES = ("email", "phone", "id_number", "address", "name")

_UP = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in range(0x100, 0x180) if chr(c).isupper())
_LOW = "a-zß-öø-ÿ" + "".join(chr(c) for c in range(0x100, 0x180) if chr(c).islower())
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:[@＠]| [@＠] | ?\((?:at|AT)\) ?| ?\[(?:at|AT)\] ?)[A-Za-z0-9-]+(?:(?:\.| ?\((?:dot|DOT)\) ?| ?\[(?:dot|DOT)\] ?)[A-Za-z0-9-]+)*(?:\.| ?\((?:dot|DOT)\) ?| ?\[(?:dot|DOT)\] ?)[A-Za-z]{2,}(?![A-Za-z0-9])")

# --- fixed values: words of addresses, by language
_T = rf"[{_UP}][\w’'-]*"
_TT = rf"[{_UP}][{_LOW}’'-]+"
_TOWN = rf"{_TT}(?: {_TT})?"
_UK = r"[A-Z]{1,2}\d{1,2} \d[A-Z]{2}"
_EN = r"(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave\.|Row|Ropewalk|Way|Close|Drive|Court|Place|Terrace|Square|Hill|Walk|Crescent|Boulevard|Blvd\.|Quay|Mews)"
_C = r"[А-ЯЁЄІЇҐ][\w’-]+"
_CITY = rf"(?:г|м|с|п|смт)\. ?{_C}(?: {_C})?"
_STREET = rf"(?:(?:ул|пр|пер|пл|ш|наб|вул|пров|просп|бул)\. ?{_C}(?: {_C})?|{_C} (?:ул|пр|пер|пл|ш|наб|вул|пров|просп|бул)\.)"
_HOUSE = r"(?:(?:дом|д\.|буд\.|будинок) ?)?\d+[a-zа-я]?(?:, ?(?:кв|корп|стр|оф)\. ?\d+)*"
_HAN = "一-鿿ヶ々"
ADDRESS = [
    re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[a-z]?, )?\d+[a-z]? (?:{_T}\.? ){{0,3}}(?:{_EN})(?:,? (?:Apt|Flat|Unit|Suite)\.? ?\w+)?, {_TOWN}(?:,? (?:[A-Z]{{2}} )?(?:{_UK}|\d{{5}}))?"),
    re.compile(rf"\d+[a-z]? Old {_T}, {_TOWN}(?: (?:{_UK}|\d{{5}}))?"),
    re.compile(rf"P\. ?O\. ?Box \d+, {_TOWN}(?: (?:{_UK}|\d{{5}}))?"),
    re.compile(rf"(?:{_T}(?:str\.|straße|strasse|gasse|weg|platz|allee|ufer|damm|ring|markt)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den) {_T}(?: {_T})?) \d+[a-z]?, \d{{5}} {_T}"),
    re.compile(rf"\d+(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|chemin|allée|place|quai|impasse|route|cours|sentier)(?: (?:de la|de l’|des|du|de|d’))? ?{_T}(?:[ -]{_T})*, \d{{5}} {_T}"),
    re.compile(rf"(?:Calle|C/|Avda\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda)(?: (?:de los|de las|de la|del|de))? ?{_T}(?: {_T})?,? (?:n\.º )?\d+[a-z]?(?:, \d+\.?[ºª°] ?\w+\.?)?, (?:\d{{5}} {_T}(?: {_T})?|{_T}(?: {_T})?)"),
    re.compile(rf"(?:Rua|Travessa|Avenida|Av\.|Largo|Praça|Estrada|Beco|Alameda)(?: (?:das|dos|da|do|de))? {_T}(?: {_T})?,? (?:n\.º )?\d+[a-z]?(?:, \d+\.?[ºª°] ?\w+\.?)?, (?:\d{{4}}-\d{{3}} )?{_T}(?: {_T})?"),
    re.compile(rf"(?:\d{{5,6}}, )?{_CITY}, {_STREET}, {_HOUSE}"),
    re.compile(rf"(?:\d{{5,6}}, )?{_STREET}, {_HOUSE}, {_CITY}"),
    re.compile(rf"{_T}(?: {_T})? (?:g|al|pr|pl|skg)\. \d+[a-z]?(?:-\d+)?, (?:LT-\d{{5}} )?{_T}"),
    re.compile(r"(?:רחוב|שדרות|סמטת|דרך|כיכר) [א-ת\"'-]+ \d+(?:, דירה \d+)?, [א-ת]+ [א-ת]+"),
    re.compile("\\d+ [ऀ-ॿ]+ (?:मार्ग|सड़क|रोड), [ऀ-ॿ]+ \\d{6}|(?:मकान|फ़्लैट) \\d+, [ऀ-ॿ]+ (?:गली|मार्ग|सड़क), [ऀ-ॿ]+(?: \\d{6})?"),
    re.compile(rf"〒\d{{3}}-\d{{4}} ?[{_HAN}]{{1,4}}?[都道府県][{_HAN}]{{1,8}}?[市区郡][{_HAN}]+?\d+(?:番地|丁目|-)?[\d\-番号]*|[{_HAN}]{{1,4}}?[都道府県][{_HAN}]{{1,8}}?[市区郡][{_HAN}]+?\d+(?:-\d+){{1,2}}"),
    re.compile(rf"(?:[{_HAN}]{{2}}省)?[{_HAN}]{{2}}市[{_HAN}]{{1,6}}?[街路巷道]\d+号(?:\d+栋)?(?:\d+单元)?(?:\d+室)?"),
    re.compile("\\d+(?:/\\d+)? (?:ถนน|ซอย|ตรอก)[฀-๿]+(?: [฀-๿]+){0,3} \\d{5}"),
]
# --- fixed values: a word or mark that each of these forms holds
_HOLDS = [
    _EN.replace("(?:", r"\b(?:", 1), r"\d Old ", r"P\. ?O\. ?Box", r"(?:str\.|straße|strasse|gasse|weg|platz|allee|ufer|damm|ring|markt) \d|(?:Am|An de[rn]|Im|In der|Zu[mr]|Auf de[mr]|Unter den) ", r"rue|avenue|av\.|boulevard|bd|chemin|allée|place|quai|impasse|route|cours|sentier",
    r"Calle|C/|Avda\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda", r"Rua|Travessa|Avenida|Av\.|Largo|Praça|Estrada|Beco|Alameda", r"(?:ул|пр|пер|пл|ш|наб|вул|пров|просп|бул)\.", r"(?:ул|пр|пер|пл|ш|наб|вул|пров|просп|бул)\.", r" (?:g|al|pr|pl|skg)\. \d", r"רחוב|שדרות|סמטת|דרך|כיכר",
    "मार्ग|सड़क|रोड|मकान|फ़्लैट", "[市区郡]", "号", "ถนน|ซอย|ตรอก",
]
ADDRESS = [(re.compile(w), p) for w, p in zip(_HOLDS, ADDRESS, strict=True)]

# --- fixed values: words before identity numbers, and words before numbers that are none
ID_CUE = re.compile(
    r"(?:passport(?: number| no\.?)?|identity number|identity card|ID(?: number)?|national insurance(?: number)?|social security(?: number)?|ticket|Ausweisnummer|Leserausweis|Personalausweis|Steuer-?ID|numéro d.identité|carte de lecteur|pièce d.identité|numéro de sécurité sociale|número de documento|número de identidad|carné|DNI|NIE|número do documento|cartão de leitor|cartão|NIF|"
    r"номер документа|документ|паспорт|читательский билет|ИНН|СНИЛС|квиток|паспорта|РНОКПП|asmens kodas|kortelė|skaitytojo bilietas|מספר (?:ה)?זהות(?: שלי)?|תעודת זהות|पहचान संख्या|आधार|证件号码|身份证号|身分証番号|マイナンバー|เลขประจำตัว(?:ของฉัน)?(?:คือ)?|บัตร)"
    r"(?:\s?(?:is|no\.|number|lautet|est le|est|es|é|ist|:|：|=|№|n\.º|है|是|は|คือ|nr\.)){0,2}\s?$",
    re.I,
)
NOT_ID = re.compile(r"(?:ISBN|ISSN|doi|catalogue n|catalogue|catálogo|catalog|shelf mark|shelf|cote|signatur|bestellnummer|шифр|каталож\w*|整理番号|索书号|version|chapter|chapitre|kapitel|глава|pages?|seiten|страниц\w*|строка|line|zeile|№ заказа|\border|\binvoice|\bno\.|n°|n\.º)[^.!?\n]{0,14}$", re.I)
ID_VALUE = re.compile(r"(?<![A-Za-zА-Яа-я0-9@.-])(?=[A-ZХ]{0,4} ?[0-9A-ZХ]*[0-9ХX])[0-9A-ZХ]{1,34}(?:[ \-‐–](?=[0-9A-ZХ]*[\d]|[A-Z](?![\w’]))[0-9A-ZХ]{1,9})*(?![A-Za-zА-Яа-я0-9@])")

#: Account numbers, which may have groups of letters alone.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![A-Za-z0-9])")

_D = "0-9०-९０-９๐-๙"
PHONE = re.compile(rf"(?<![A-Za-zА-Яа-я{_D}@./,\-+])(?=[+＋({_D}])(?:\+|＋)?[{_D}]{{0,4}}[ \-]?(?:\([{_D}~ ]{{1,6}}\)[ \-]?)?[{_D}]{{1,11}}(?:[ .\-－‐–/][{_D}]{{1,8}}){{0,6}}(?![A-Za-zА-Яа-я{_D}@])")
# --- fixed values: words before telephone numbers
PHONE_CUE = re.compile(
    r"(?:reach me on|reach me at|phone(?: number)?(?: is)?|telephone|mobile|call(?: me)?(?: on| at)?|ring|tel\.?|tél\.?|teléfono(?: es)?|telefone(?: é)?|telefon(?:isch|as|u)?|erreichen sie mich unter|unter|joindre au|appelez(?:-moi)?(?: au)?|llámeme al|llame al|ligue(?: para)?|телефон|тел\.|звоните(?: по)?|дзвоніть|skambinkite|הטלפון שלי|טלפון|फ़ोन|电话是?|電話は?|โทรหาฉันที่|โทร|nobody at|try|instead of|"
    r"(?<=[\w)\]] )(?:or|oder|ou|o|или|або|arba|או|या|หรือ)|或|か|は|是)\s?[:：]?\s?$",
    re.I,
)

# --- fixed values: words that tell of a person, by what they do. INTRO, CLOSE, ROLE and TITLE stand right before a name; WORK
# and DONE before it, within its clause, WORK with a preposition; ACTS right behind it
INTRO = (
    "my name is|his name is|her name is|name is|i am called|name:|ich heiße|ich heisse|mein name ist|je m'appelle|je m’appelle|mon nom est|me llamo|mi nombre es|chamo-me|me chamo|meu nome é|"
    "меня зовут|его зовут|её зовут|мене звати|його звати|її звати|mano vardas"
).split("|")
CLOSE = (
    "best wishes|kind regards|best regards|warm regards|regards|yours sincerely|sincerely|yours faithfully|yours truly|yours|with thanks|many thanks|freundlichen grüßen|freundliche grüße|viele grüße|beste grüße|herzliche grüße|hochachtungsvoll|"
    "cordialement|bien à vous|salutations|amicalement|respectueusement|saludos|atentamente|un saludo|cordialmente|cumprimentos|atenciosamente|saudações|um abraço|с уважением|искренне ваш|искренне ваша|с благодарностью|з повагою|щиро ваш|щиро ваша|з подякою|pagarbiai|su pagarba|nuoširdžiai"
).split("|")
ROLE = (
    "reader|subscriber|contact|author|editor|editors|translator|proofreader|reviewer|borrower|customer|recipient|sender|leser|leserin|abonnent|abonnentin|kontakt|autor|autorin|übersetzer|übersetzerin|empfänger|absender|"
    "lecteur|lectrice|abonné|abonnée|auteur|traducteur|traductrice|relecteur|relectrice|lector|lectora|suscriptor|suscriptora|contacto|autora|traductor|traductora|leitor|leitora|assinante|contato|tradutor|tradutora|"
    "читатель|читательница|подписчик|подписчица|контакт|автор|переводчик|редактор|корректор|читач|читачка|передплатник|передплатниця|перекладач|коректор|skaitytojas|skaitytoja|prenumeratorius|kontaktas|autorius|vertėjas|vertėja"
).split("|")
TITLE = "mr|mrs|ms|miss|dr|prof|herr|frau|monsieur|madame|mme|señor|señora|senhor|senhora|господин|госпожа|г-н|г-жа|пан|пані|ponas|ponia|dear|signed".split("|")
WORK = (
    "proofread|translated|edited|written|corrected|reviewed|revised|illustrated|typeset|checked|issued|lent|belongs|belonging|sent|went|forwarded|handed|delivered|addressed|mailed|posted|given|gave|spoke|talked|met|interview|letter|reply|ask|write|card|"
    "korrektur|übersetzt|lektoriert|geschrieben|verfasst|ausgestellt|gehören|gingen|ging|geschickt|gesandt|übergeben|gesprochen|sprach|brief|"
    "relu|traduit|corrigé|écrit|édité|appartient|délivrée|délivré|parties|partis|envoyées|envoyés|envoyé|remises|remis|transmis|parlé|demandez|lettre|"
    "corregido|traducido|escrito|editado|revisado|pertenece|expedido|expedida|salieron|salió|enviadas|enviado|entregadas|entregado|hablé|pregunte|es|carta|"
    "revisto|traduzido|pertence|emitido|seguiram|seguiu|entregue|entregues|falei|enviados"
).split("|")
DONE = (
    "gehört|fragen|получил|получила|делал|делала|перевёл|перевел|перевела|редактировал|редактировала|проверил|проверила|написал|написала|выдан|выдана|выдано|принадлежит|отправлен|отправлена|отправлены|передан|переданы|спросите|говорил|говорила|письмо|"
    "отримав|отримала|робив|робила|переклав|переклала|редагував|редагувала|перевірив|перевірила|написав|видано|видана|належить|надіслано|передано|спитайте|запитайте|лист|"
    "gavo|taisė|išvertė|vertė|redagavo|tikrino|parašė|išduotas|išduota|priklauso|išsiųsta|perduota").split("|")
ACTS = (
    "lives|signed|corrected|asked|asks|wrote|writes|translated|proofread|edited|requested|ordered|wohnt|bittet|schrieb|schreibt|unterschrieb|fragte|fragt|übersetzte|korrigierte|bestellte|habite|demande|souhaite|"
    "vive|pide|pidió|escribió|firmó|tradujo|corrigió|solicita|mora|pede|pediu|escreveu|assinou|traduziu|corrigiu|живёт|живет|проживает|просит|просила|просил|подписал|подписала|спрашивает|заказал|заказала|"
    "мешкає|живе|просить|просив|підписав|підписала|замовив|замовила|gyvena|prašo|parašė|pasirašė|išvertė|užsakė"
).split("|")
#: What each kind of word, a neighbouring mail or postal address, and the name's own shape add; what a place or thing takes away.
CUE = {"intro": 0.7, "close": 0.6, "role": 0.5, "title": 0.45, "work": 0.5, "done": 0.5, "acts": 0.35}
BESIDE, HOME, TWO, INITIAL, INNER, THING = 0.55, 0.3, 0.15, 0.1, 0.15, -0.5
_CLAUSE = r"(?:[^.!?;:,\n|()“”«»„\"]{0,44}?[\s\u00a0](?:by|to|with|for|from|of|an|von|für|auf|bei|mit|nach|par|à|chez|de|pour|avec|por|a|para|con|com|ao|с|со|к|на|для|от|з|із|від|su|nuo)"
_CAPITAL = r"(?=[A-ZÀ-ÞЀ-Я\u0100-\u017fҐ])"
_GAPS = {
    "intro": re.compile(r"[:,]?[\s\u00a0]{1,2}"), "close": re.compile(r",\s{1,3}|\n{1,2}"), "role": re.compile(r"(?: ?:)?[\s\u00a0]{1,2}"), "title": re.compile(r"\.?[\s\u00a0]"),
    "work": re.compile(_CLAUSE + r"|:)[\s\u00a0]" + _CAPITAL), "done": re.compile(_CLAUSE + r"|:|)[\s\u00a0]" + _CAPITAL),
}
# --- fixed values: words before a name that make it a thing, and the last words of names of places
_THING = re.compile(r"(?:\b(?:the|ship|vessel|schooner|boat|book|novel|inn|street|port|island|town|village|das|die|der|schiff|roman|buch|le|la|les|navire|el|los|las|barco|libro|navio|livro|судно|шхуна|книга|роман|город|laivas|knyga)\s|[“„«‘]\s?)$", re.I)
# --- fixed values: names in scripts without capitals: roles, closings and verbs of giving around them
_DEV, _THAI = "ऀ-ॣॱ-ॿ", "ก-๎"
_GIVEN = "[送渡届預贈]"
CASELESS = [
    re.compile(r"(?:(?:קורא|קוראת|מנוי|מנויה|מחבר|מחברת|עורך|עורכת|מתרגם|מתרגמת|איש קשר)(?: חדש| חדשה)?:|בברכה,|בכבוד רב,|בתודה,|שמי|קוראים לי|(?:נשלחו|נשלח|נמסר|נמסרו|הועבר|שייך|שייכת) (?:אל|ל)) ?([א-ת][א-ת'׳\"-]*(?:\.)? [א-ת][א-ת'׳-]+(?:-[א-ת]+)?)"),
    re.compile(r"(?:קורא|קוראת|מנוי|מנויה)(?: חדש| חדשה)?: ([א-ת][א-ת'׳\". -]*?)(?= ?\|)"),
    re.compile(rf"(?:(?:पाठक|ग्राहक|लेखक|संपादक|अनुवादक|संपर्क):|सादर,|धन्यवाद,|(?:मेरा|उसका|उनका) नाम|प्रूफ़|श्रीमती|श्री) ?([{_DEV}]+(?:\.)? [{_DEV}]+)(?!:)"),
    re.compile(rf"([{_DEV}]{{3,}}(?:\.)? [{_DEV}]{{3,}}) को (?:भेजे|भेजा|भेजी|दिए|दिया|दी|सौंपे|सौंपा)"),
    re.compile(rf"(?:पाठक|ग्राहक): ([{_DEV}. ]+?)(?= ?\|)"),
    re.compile(rf"(?:新读者|新订户|新讀者|联系人|姓名|收件人)：([{_HAN}·]{{2,6}}?)(?=[，,|<（(])|(?<!新)(?:读者|作者|译者|编辑|校对|收件人|联系人)：([{_HAN}·]{{2,4}}?(?=[，。,|<（(《“「]|我的|请|有问题|校样|新读者|读者：|索书|如果|$|\n)|[{_HAN}·]{{4}})|(?:我叫|我的名字是|我名叫|此致敬礼，|[寄送交发][给至])([{_HAN}·]{{2,4}})(?=[，。！,.了]|$|\n)"),
    re.compile(rf"(?:読者|購読者|著者|訳者|校正者|編集者|担当|連絡先|宛先)：([{_HAN}ぁ-んァ-ヶー]+(?: [{_HAN}ぁ-んァ-ヶー]+)?)(?=[、,|。]|$|\n)|は([{_HAN}ァ-ヶー]+[ぁ-ん]{{0,2}}(?: [{_HAN}ァ-ヶー]+)?)(?:に|へ|さんに|様に){_GIVEN}|私は([{_HAN}]+(?: [{_HAN}]+)?)と(?:申し|いい|言い)|(?:敬具|敬具、|かしこ、?) ?([{_HAN}]+ ?[{_HAN}]+)"),
    re.compile(rf"(?:ผู้อ่านใหม่:|ผู้อ่าน:|สมาชิก:|ผู้เขียน:|ผู้แปล:|ด้วยความเคารพ|ขอแสดงความนับถือ|ฉันชื่อ|ผมชื่อ|ชื่อของฉันคือ|(?:ส่ง|มอบ|ฝาก)[{_THAI}]{{0,8}}?(?:ถึง|ให้|แก่)) ?([{_THAI}]+\.? [{_THAI}]+)"),
]
_CASELESS_HINT = re.compile("[א-תऀ-ॿ฀-๿一-鿿]")

_CAP = rf"(?:[{_UP}А-ЯЁЄІЇҐ][^\W\d_]+(?:[’'‑-][^\W\d_]+)*)"
_TOKEN = re.compile(rf"(?:[A-ZÀ-ÖØ-ÞА-ЯЁЄІЇҐ]\.(?!O\.)|(?:(?:van der|van den|van|von der|von|zu|de la|del|de|da|dos|di|du|le|la|af|ter|O’|Mc|Mac) ?)?{_CAP})")
_FIRST = re.compile(rf"(?:[A-ZÀ-ÖØ-ÞА-ЯЁЄІЇҐ]\.|{_CAP})")
# --- fixed values: capitalised words that are no part of a name
TOWN_WORDS = {"quay", "falls", "bay", "harbour", "hill", "bridge", "ferry", "wells", "green", "park", "heights", "springs", "city", "town", "beach", "point", "port", "mills", "cross", "end"}
NO_NAME = {"reader", "subscriber", "leser", "leserin", "lecteur", "lector", "leitor", "читатель", "читач", "skaitytojas", "contact", "kontakt", "contacto", "контакт", "isbn", "p", "box", "apt", "flat", "tel", "chapter", "the", "doi", "pdf"}
# --- fixed values: words that begin sentences and are seldom written small
NO_NAME |= set(
    "nobody translated proofread library catalogue new please meet main it errata if my write ask questions dear best "
    "dúvidas schreiben telefonisch meine bestellnummer rückfragen neuer bitte der die das wer "
    "knygą asmens rašykite klausimai mano naujas korektūrą pagarbiai écrivez envoyez mon questions nouvel cordialement "
    "envíe mi escríbame dudas nuevo saludos escreva envie novo cumprimentos meu "
    "пишите звоните номер посылка печатный каталожный шифр глава вычитку корректуру читательский новый роман шхуна "
    "пишіть примірник мій коректуру новий запитання who wer qui quién quem кто хто kas mit".split()
)
NO_NAME |= {w.split(" ")[0].strip(":") for w in INTRO + CLOSE}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(digits: str) -> bool:
    """A number whose last two digits are 97 less the rest modulo 97, or that is 1 modulo 97 as an IBAN is."""
    return len(digits) > 4 and (97 - int(digits[:-2]) % 97 == int(digits[-2:]) or int(digits) % 97 == 1)


def mod11(digits: str) -> bool:
    return len(digits) > 4 and sum(int(c) * w for c, w in zip(reversed(digits), range(1, len(digits) + 1))) % 11 == 0


def _weighed(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(c) * w for c, w in zip(digits, weights))


def iban(v: str) -> bool:
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def french(v: str) -> bool:
    return mod97(v.replace("2A", "19").replace("2B", "18"))


def chinese(v: str) -> bool:
    return "10X98765432"[_weighed(v, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)) % 11] == v[17].replace("Х", "X")


def spanish(v: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(v[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == v[-1]


def snils(v: str) -> bool:
    return _weighed(v, (9, 8, 7, 6, 5, 4, 3, 2, 1)) % 101 % 100 == int(v[9:])


def inn(v: str) -> bool:
    a, b = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    return _weighed(v, a) % 11 % 10 == int(v[10]) and _weighed(v, b) % 11 % 10 == int(v[11])


def lithuanian(v: str) -> bool:
    rest = _weighed(v, (1, 2, 3, 4, 5, 6, 7, 8, 9, 1)) % 11
    rest = _weighed(v, (3, 4, 5, 6, 7, 8, 9, 1, 2, 3)) % 11 % 10 if rest == 10 else rest
    return rest == int(v[10])


def german_tax(v: str) -> bool:
    """ISO 7064 mod 11, 10; of the first ten digits one stands two or three times."""
    product = 10
    for c in v[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(v[10]) and len(set(v[:10])) in (8, 9)


def german_card(v: str) -> bool:
    return sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(v[:9])) % 10 == int(v[9])


def portuguese_card(v: str) -> bool:
    values = [int(c, 36) * (1 + i % 2) for i, c in enumerate(reversed(v))]
    return sum(x - 9 * (i % 2 and x > 9) for i, x in enumerate(values)) % 10 == 0


def portuguese(v: str) -> bool:
    return (11 - _weighed(v, (9, 8, 7, 6, 5, 4, 3, 2)) % 11) % 11 % 10 == int(v[8])


def thai(v: str) -> bool:
    return (11 - _weighed(v, tuple(range(13, 1, -1))) % 11) % 10 == int(v[12])


def japanese(v: str) -> bool:
    rest = _weighed(v, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11
    return (11 - rest if rest > 1 else 0) == int(v[11])


_TURN = "1576283094"


def verhoeff(v: str) -> bool:
    """The check of Aadhaar numbers: multiplication in the dihedral group of order 10."""
    total = 0
    for i, c in enumerate(reversed(v)):
        x = int(c)
        for _ in range(i % 8):
            x = int(_TURN[x])
        a, b = divmod(total, 5), divmod(x, 5)
        total = 5 * (a[0] ^ b[0]) + (a[1] + (-b[1] if a[0] else b[1])) % 5
    return total == 0


# --- fixed values: forms of numbers with a checksum: the form, its check over the digits and letters, and what else the
# text around must hold where the form alone is shared by other numbers
FORMS = [
    (IBAN, iban, None),
    (re.compile(r"[3-6]\d{3}(?P<b>[ -])\d{4}(?P=b)\d{4}(?P=b)\d{4}|3[47]\d\d \d{6} \d{5}|[3-6]\d{14,15}"), luhn, None),
    (re.compile(r"\d ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d"), french, None),
    (re.compile(r"\d{17}[\dXХ]"), chinese, None),
    (re.compile(r"\d{8}[ -]?[A-Z]|[XYZ][ -]?\d{7}[ -]?[A-Z]"), spanish, None),
    (re.compile(r"\d{3}-\d{3}-\d{3}[ -]\d\d"), snils, None),
    (re.compile(r"\d{12}"), inn, re.compile("[А-яЁё]")),
    (re.compile(r"[1-6]\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{4}"), lithuanian, None),
    (re.compile(r"[1-9]\d \d{3} \d{3} \d{3}|[1-9]\d{10}"), german_tax, None),
    (re.compile(r"[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}\d"), german_card, None),
    (re.compile(r"\d{8} ?\d ?[0-9A-Z]{2}\d"), portuguese_card, re.compile("[ãõçáéêó]")),
    (re.compile(r"[1-35689]\d\d ?\d{3} ?\d{3}"), portuguese, re.compile("[ãõç]")),
    (re.compile(r"\d-\d{4}-\d{5}-\d\d-\d|\d \d{4} \d{5} \d\d \d|[1-8]\d{12}"), thai, re.compile("[฀-๿]")),
    (re.compile(r"\d{4}(?P<b>[ -]?)\d{4}(?P=b)\d{4}"), japanese, re.compile("[ぁ-んァ-ヶ]")),
    (re.compile(r"[2-9]\d{3}(?P<b>[ -]?)\d{4}(?P=b)\d{4}"), verhoeff, re.compile("[ऀ-ॿ]")),
    (re.compile(r"\d{9}|\d{8}-\d"), luhn, re.compile("[א-ת]")),
    (re.compile(r"[1-9]\d\d \d{3} \d{4}"), mod11, re.compile("[A-Za-z]")),
]
#: What a number has of itself, and what a checksum, a cue, the place in a record and a word for telephones add.
BASE, VALID, FAILS, CUED, FIELD, PHONED = 0.3, 0.3, -0.1, 0.65, 0.63, -0.3


_NOT_BARE = re.compile(r"[^0-9A-ZХ]")
_FIELD = re.compile(r"(?:\s?\|\s?|[，、]\s?)$")
_RECORD = re.compile(r"\|\s?$")
_YEARS = re.compile(r"1\d{3}[-–]1\d{3}")
_FORM = re.compile(r"\(\d{3}\) ?\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|001 \d{3} \d{3} \d{4}|0\d{3,4} \d{3} \d{3,4}|020 \d{4} \d{4}|8 ?\(\d{3}\) ?[\d-]{7,9}")
#: Where a number may lie: digits with what joins them, and the letters before them.
_SPOT = re.compile(r"\d")


def _windows(text: str) -> list[tuple[int, int]]:
    """The neighbourhoods of digits, joined where they meet, ending where no number goes on."""
    out: list[list[int]] = []
    for m in _SPOT.finditer(text):
        s, e = max(0, m.start() - 48), min(len(text), m.end() + 48)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def checksum(value: str, around: str = "") -> bool | None:
    """Whether the checksum of the value's form holds, in any of the forms it may have; None: it has none with a checksum."""
    bare = _NOT_BARE.sub("", value)
    asked = [check(bare) for form, check, near in FORMS if form.fullmatch(value) and (near is None or near.search(around))]
    return any(asked) if asked else None


def _number(text: str) -> str:
    return "".join(str(int(c)) if c.isdigit() else c for c in text)


_PARTICLE = re.compile(r" (?:van|von|de|da|di|du|del|la|le|zu|af|ter|der|den) ")
_GAP, _COMMA = re.compile(r"[ \u00a0]"), re.compile(r", ")
_INSIDE = re.compile(rf" ?(?:{_CAP})")
_BACK = re.compile(rf"(?:^|(?<=[\s(«“„\"|,;:—–-]))((?:O’|Mc|Mac)?{_CAP}|[A-ZÀ-ÖØ-ÞА-ЯЁЄІЇҐ]\.)$")
_OF = re.compile(r"(?:van der|van|von|de la|de|da|di|du) $")
_AFTER_OF = re.compile(rf"(?:{_CAP}|[A-Z]\.) (?:van der|van|von|de la|de|da|di|du) $")
_SIGNED = re.compile(r"[—–-] ([^—–|\n]{2,60}), $")
_DIGITS = re.compile(r"\d")
#: A capital inside a sentence, which tells something where not all nouns have one.
_WITHIN = re.compile(r"[^\W\d_A-ZÀ-Þ] $")
_GERMAN = re.compile(r"\b(?:der|die|das|dem|den|des|und|ein|eine|einen|im|am|vom|zum)\b", re.I)


@lru_cache(1)
def _cues():
    """All words that tell of a person, found in one pass over a text."""
    import ahocorasick

    out: dict[str, list[str]] = {}
    for kind, words in (("intro", INTRO), ("close", CLOSE), ("role", ROLE), ("title", TITLE), ("work", WORK), ("done", DONE), ("acts", ACTS)):
        for w in words:
            out.setdefault(w, []).append(kind)
    a = ahocorasick.Automaton()
    for w, kinds in out.items():
        a.add_word(w, (len(w), tuple(kinds)))
    a.make_automaton()
    return a


def _small(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] for c in text)


class Finder:
    def __init__(self, common):
        self.common = common

    def _plain(self, word: str) -> bool:
        """Whether a capitalised word is an ordinary one."""
        w = word.strip("’'.-").lower()
        return w in NO_NAME or w in self.common

    def name_after(self, text: str, at: int) -> int | None:
        """End of the name that begins at ``at``."""
        m = _FIRST.match(text, at)
        if not m or self._plain(m[0]) and len(m[0]) > 2:
            return None
        end, n, comma, whole, places = m.end(), 1, False, int(not m[0].endswith(".")), [m.end()]
        while n < 5:
            gap = _GAP.match(text, end) or (not comma and n == whole == 1 and _COMMA.match(text, end))
            at_next = gap.end() if gap else end
            if not gap and text[end - 1] != ".":
                break
            m = _TOKEN.match(text, at_next)
            if not m or text.startswith("P.O", at_next):
                break
            last = m[0].split(" ")[-1]
            initial = last.endswith(".")
            if not initial and self._plain(last):
                break
            if gap and gap[0] == ", ":
                comma = True
            if initial and not (n == 1 or comma or text[end - 1] == ".") and not _INSIDE.match(text, m.end()):
                break  # the first letter of what follows
            end, n, whole = m.end(), n + 1, whole + int(not initial)
            places.append(end)
            if whole >= 4:
                # four full names without a mark between them are two people
                return places[-3] if not comma and n == 4 and not _PARTICLE.search(text[at:end]) else end
        return end if whole else None

    def name_before(self, text: str, end: int) -> int | None:
        """Start of the name that ends at ``end``."""
        tokens, at = [], end
        while len(tokens) < 4:
            m = _BACK.search(text[max(0, at - 40) : at])
            if not m or self._plain(m[1]) and not m[1].endswith("."):
                break
            tokens.append(m[1])
            start = at - len(m[1])
            if start and text[start - 1] == " ":
                p = _OF.search(text[max(0, start - 9) : start])
                if p and _AFTER_OF.search(text[max(0, start - 45) : start]):
                    start -= len(p[0])
            at0, at = start, start - 1
            if start == 0 or text[at] not in " \u00a0":
                return at0 if any(not t.endswith(".") for t in tokens) else None
            if at and text[at - 1] == "," and len(tokens) <= 2:
                m = _BACK.search(text[max(0, at - 41) : at - 1])
                if m and not self._plain(m[1]):
                    return at - 1 - len(m[1])
        if len(tokens) == 4 and not any(t.endswith(".") for t in tokens):
            return end - len(tokens[0]) - 1 - len(tokens[1])  # the last two of four full names
        return at + 1 if tokens and any(not t.endswith(".") for t in tokens) else None

    def _people(self, text: str, mails: list[tuple[int, int]], places: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """Spans of names with their scores: what the words around and the name's own form add up to."""
        scores: dict[tuple[int, int], dict[str, float]] = {}
        taken = mails + places

        def add(s: int | None, e: int | None, kind: str, weight: float) -> None:
            if s is not None and e is not None and s < e and not any(a < e and s < b for a, b in taken):
                scores.setdefault((s, e), {})[kind] = weight

        low = _small(text)
        for last, (n, kinds) in _cues().iter(low):
            a, b = last - n + 1, last + 1
            if a and (low[a - 1].isalnum() or low[a - 1] == "-") or b < len(low) and (low[b].isalnum() or low[b] == "-"):
                continue
            for kind in kinds:
                if kind == "acts":
                    if a > 1 and text[a - 1] in " \u00a0":
                        home = HOME * any(b <= x <= b + 24 for x, _ in places)
                        add(self.name_before(text, a - 1), a - 1, kind, CUE[kind] + home)
                elif m := _GAPS[kind].match(text, b):
                    weight = CUE[kind] + (0.1 if kind == "role" and ":" in m[0] else 0.0)
                    add(m.end(), self.name_after(text, m.end()), kind, weight)
        for s, _ in mails:
            if s > 2 and text[s - 2 : s] in (" (", " <"):
                add(self.name_before(text, s - 2), s - 2, "beside", BESIDE)
        for s, _ in places:
            if s > 2 and text[s - 2 : s] == ", ":
                add(self.name_before(text, s - 2), s - 2, "beside", BESIDE)
                m = _SIGNED.search(text[max(0, s - 70) : s])  # a signature: dash, name, address
                if m:
                    add(max(0, s - 70) + m.start(1), self.name_after(text, max(0, s - 70) + m.start(1)), "beside", BESIDE)
        out = []
        for (s, e), got in scores.items():
            name = text[s:e]
            words = name.replace("\u00a0", " ").split(" ")
            score = sum(got.values()) + TWO * (len(words) > 1) + INITIAL * ("." in name)
            if _WITHIN.search(text[max(0, s - 2) : s]) and not _GERMAN.search(text[max(0, s - 48) : s]):
                score += INNER
            if words[-1].lower().strip(".,") in TOWN_WORDS or _THING.search(text[max(0, s - 14) : s]):
                score += THING
            out.append((score, s, e))
        return out

    def _trim(self, text: str, s: int, e: int) -> int:
        """An address ends before a capitalised ordinary word, the beginning of the next sentence."""
        tail = text[s:e].rfind(", ")
        words = [(m.start() + s, m[0]) for m in re.finditer(r"[^\s,]+", text[s:e]) if m.start() > tail and m[0][0].isalpha()]
        while len(words) > 1 and not text[e - 1].isdigit() and self._plain(words[-1][1]) and words[-1][1].lower() not in TOWN_WORDS:
            e = words.pop()[0] - 1
        return e

    def find(self, text: str) -> list[tuple[str, int, int]]:
        got: list[tuple[float, str, int, int]] = []
        digits = _DIGITS.search(text) is not None
        if "@" in text or "＠" in text or "at)" in text or "at]" in text or "AT)" in text:
            got += [(1.0, "email", m.start(), m.end()) for m in EMAIL.finditer(text)]
        mails = [(s, e) for _, _, s, e in got]
        places: list[tuple[int, int]] = []
        if digits:
            for word, p in ADDRESS:
                if not word.search(text):
                    continue
                for m in p.finditer(text):
                    e = self._trim(text, m.start(), m.end())
                    places.append((m.start(), e))
                    got.append((0.9 + len(text[m.start() : e]) / 1e4, "address", m.start(), e))
        people = [(s, e) for score, s, e in self._people(text, mails, places) if score >= ACCEPT]
        if _CASELESS_HINT.search(text):
            people += [m.span(m.lastindex) for p in CASELESS for m in p.finditer(text) if m.lastindex]
        got += [(0.8 + (e - s) / 1e4, "name", s, e) for s, e in people]
        for name in {text[s:e] for s, e in people if e - s > 6 and " " in text[s:e]}:
            at = text.find(name)
            while at >= 0:
                e = at + len(name)
                if not (at and text[at - 1].isalnum() or e < len(text) and text[e].isalnum()):
                    got.append((0.7, "name", at, e))
                at = text.find(name, e)
        if digits:
            got += self._numbers(text, mails + places, people)
        got.sort(key=lambda x: (-x[0], x[2] - x[3], x[2]))
        out: list[tuple[str, int, int]] = []
        for score, kind, s, e in got:
            if score >= ACCEPT and not any(a < e and s < b for _, a, b in out):
                out.append((kind, s, e))
        return sorted(out, key=lambda x: x[1])

    def _numbers(self, text: str, taken: list[tuple[int, int]], people: list[tuple[int, int]]):
        ends = {e for _, e in people}
        spots = _windows(text)
        for m in (m for a, b in spots for p in (ID_VALUE, IBAN) for m in p.finditer(text, a, b)):
            s, e = m.span()
            v = m[0]
            bare = _NOT_BARE.sub("", v)
            weight = sum(c.isdigit() or c in "XХ" for c in bare)
            if weight < 6 or len(bare) < 6 or any(a < e and s < b for a, b in taken):
                continue
            left = text[max(0, s - 44) : s]
            valid = checksum(v, text[max(0, s - 44) : e + 44])
            score = BASE + (0.0 if valid is None else VALID if valid else FAILS)
            if ID_CUE.search(left):
                score += CUED
            elif (q := _FIELD.search(left)) and s - len(q[0]) in ends:
                score += FIELD  # the field behind the name of a record
            elif NOT_ID.search(left) or left.endswith(("+", "＋")):
                continue
            elif PHONE_CUE.search(left):
                score += PHONED
            yield min(score, 0.99), "id_number", s, e
        for m in (m for a, b in spots for m in PHONE.finditer(text, a, b)):
            s, e = m.span()
            s += len(m[0]) - len(m[0].lstrip(" -"))
            v = _number(text[s:e])
            n = sum(c.isdigit() for c in v)
            if not 7 <= n <= 15 or any(a < e and s < b for a, b in taken):
                continue
            left = text[max(0, s - 44) : s]
            shape = (
                0.75 if v[0] in "+＋" else 0.6 if _FORM.fullmatch(v) else 0.3 if v[0] in "08(" else 0.1
            )
            cue = PHONE_CUE.search(left) is not None or _RECORD.search(left) is not None and not any(left.rstrip(" |").endswith(text[a:b][-8:]) for a, b in people if b <= s)
            cue = cue or any(e0 <= s <= e0 + 3 and text[e0:s] in (", ", " ,") for e0 in ends)
            if NOT_ID.search(left) or _YEARS.fullmatch(v):
                continue
            score = shape + (0.5 if cue else 0.0)
            if ID_CUE.search(left):
                score -= 0.6
            yield min(score, 0.92), "phone", s, e


_ANY_WORD = re.compile(r"(?<![\w’'-])[^\W\d_]{2,}")
#: A word is an ordinary one if it was written small so often, and in this share of its uses.
TIMES, SHARE = 2, 0.1
#: Bits of the filter that stands for the ordinary words, and how many bits a word sets.
BITS, MARKS = 1 << 25, 2


def _word_uses(batches):
    """(word in small letters, times written small, times written at all)."""
    seen: Counter[str] = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                seen.update(_ANY_WORD.findall(EMAIL.sub(" ", t) if "@" in t or "＠" in t or "at)" in t or "at]" in t else t))
        if len(seen) > 1_000_000:  # a huge partition sends what it has
            yield _uses(seen)
            seen = Counter()
    if seen:
        yield _uses(seen)


def _uses(seen: Counter) -> pa.RecordBatch:
    small: Counter[str] = Counter()
    all_: Counter[str] = Counter()
    for w, n in seen.items():
        low = w.lower()
        if low == w.upper():
            continue  # a script without capitals
        all_[low] += n
        if w == low:
            small[low] += n
    return pa.RecordBatch.from_arrays([pa.array(list(all_), pa.string()), pa.array([small[w] for w in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], ["w", "small", "n"])


def _marks(word: str) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return [h & (BITS - 1), (h >> 32) & (BITS - 1)]


class Words:
    """The ordinary words, as a Bloom filter of fixed size."""

    def __init__(self, bits: bytes):
        self.bits, self.known = bits, {}

    def __reduce__(self):
        return Words, (self.bits,)

    def __contains__(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = all(self.bits[k >> 3] >> (k & 7) & 1 for k in _marks(word))
        return got


def _bit_rows(batches):
    for b in batches:
        bits: dict[int, int] = {}
        for w in b.column(0).to_pylist():
            for k in _marks(w):
                bits[k >> 5] = bits.get(k >> 5, 0) | 1 << (k & 31)
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(list(bits.values()), pa.int64())], ["at", "bits"])


def common_words(documents: DataFrame) -> Words:
    """Words that the documents write in small letters, counted over all of them; one scan. What comes to the driver and is
    broadcast is a filter of ``BITS`` bits, whatever the number of words."""
    import numpy as np

    n = documents.select("text").mapInArrow(_word_uses, "w string, small long, n long").groupBy("w").agg(F.sum("small").alias("small"), F.sum("n").alias("n"))
    rows = n.where((F.col("small") >= TIMES) & (F.col("small") >= SHARE * F.col("n"))).select("w").mapInArrow(_bit_rows, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITS // 32, np.uint32)
    for b in rows.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    return Words(out.tobytes())


def personal(documents: DataFrame, common: Words | frozenset[str] | None = None) -> DataFrame:
    """documents: doc_id, text. One row an item: doc_id, pii_type, s, e, value."""
    common = common if common is not None else common_words(documents)
    ship = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        f = Finder(ship.value)
        for b in batches:
            rows = [(d, k, s, e, t[s:e]) for d, t in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))) if t for k, s, e in f.find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "pii_type", "s", "e", "value"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, pii_type string, s long, e long, value string")


def masked(documents: DataFrame, common: Words | frozenset[str] | None = None) -> DataFrame:
    """doc_id and the text with a typed placeholder in place of each item."""
    common = common if common is not None else common_words(documents)
    ship = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        f = Finder(ship.value)
        for b in batches:
            ids, texts = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            out = []
            for t in texts.to_pylist():
                for k, s, e in reversed(f.find(t)) if t else ():
                    t = f"{t[:s]}[{k.upper()}]{t[e:]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["doc_id", "masked_text"])

    return documents.select("doc_id", "text").mapInArrow(run, documents.select("doc_id", F.col("text").alias("masked_text")).schema)
