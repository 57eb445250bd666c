"""Template residue, filler, error pages and script notices (problem 8).

Two tests, both outside code, quotations, math and links:

* an unfilled placeholder standing where content belongs excludes a document;
* a multi-pattern automaton (Aho-Corasick) marks phrases of error pages, filler text and
  script notices in many languages; another one finds the openings of placeholders.  A sentence counts as residue when the phrases cover
  most of it, a document when such sentences cover most of its body.  Navigation and
  headings are neither residue nor body; a body that repeats itself is filler.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.runtime import spread

#: Share of a sentence that phrases must cover, and of the body that residue must cover.
SENTENCE_SHARE, BODY_SHARE = 0.5, 0.6
#: Characters up to which a body under a bare error message belongs to the error page.
SHORT_PAGE = 300

# Names of fields that templates ask for.
FIELDS = (
    "author|title|maintainer|summary|company|product|version|module|project|project_name|name|first_name|last_name|full_name|docs_url|url|link|release|release_date|"
    "date|email|mail|phone|address|city|country|user|username|description|section|chapter|subject|customer|client|organisation|organization|team|repo|repository|language|year|price|logo|image"
)
_NAME = r"[A-Za-z][\w.\-]*(?: [A-Za-z][\w.\-]*)*"
# Notations of unfilled placeholders.
PLACEHOLDERS = re.compile(
    "|".join(
        [
            r"\{\{\{?[^{}\n]+\}?\}\}", r"\{%[^%{}\n]+%\}", r"\{#[^#{}\n]+#\}", r"<%[=-]?[^%<>\n]+%>", r"[$#]\{[^{}\n]+\}",
            r"@@[A-Za-z_]{2,}@@", rf"%(?:{FIELDS}|[A-Z]+_[A-Z_]+)%", r"%%[A-Z_]{2,}%%", r"\*\|[A-Z_:]{2,}\|\*", r"%\([a-z_]{2,}\)[sdr]", rf"\$(?:{FIELDS}|[A-Z]+_[A-Z_]+)\$", rf"__(?:{FIELDS}|[A-Z]+_[A-Z_]+)__(?!\w)",
            rf"<<\s*{_NAME}\s*>>", rf"(?<!\[)\[\[\s+{_NAME}\s+\]\]", rf"(?<![\\${{^_\w}}])\{{(?:[a-z]+_)*(?:{FIELDS})\}}",
            rf"<(?:insert|your|enter|add|fill in)\s+{_NAME}>", rf"\[(?:insert|your|enter|fill in|add)\s+{_NAME}\](?!\()", rf"\[{_NAME}\s+(?:tbd|tba|todo|here|goes here)\](?!\()",
            rf"\((?:insert|fill in|enter)\s+{_NAME}(?:\s+here)?\)", rf"\({_NAME}\s+(?:goes|comes)\s+here\)", r"\[object\s+object\]", r"\[(?:todo|tbd|tba|tk)\b[^\]\n]*\](?!\()",
            rf"(?<!\w)(?:dear|hi|hello|hola|bonjour|hallo|sehr geehrte(?:/?r|r frau)?)\s+(?:mr\.?\s+|ms\.?\s+)?[\[<](?:{FIELDS})[\]>]", r"<[A-Z]{2,}(?: [A-Z]{2,})+>",
            r"(?<![\w-])TKTK(?!\w)", r"(?<![\w-])X{4}(?!X|\w)", r"(?<![\w`'\"-])undefined(?![\w`'\"-])",
        ]
    ),
    re.I,
)
#: Every placeholder holds one of these strings, or has one of the notations of the short pattern.
_HINTS = (
    "{{", "{%", "{#", "<%", "${", "#{", "@@", "%(", "%%", "*|", "<<", "[[ ", "<insert", "<your", "<enter", "<add", "<fill", "[insert", "[your", "[enter", "[fill", "[add",
    "(insert", "(fill", "(enter", " here)", " here]", "tbd]", "tba]", "todo]", "[tbd", "[tba", "[todo", "[tk", "[object", "here)", "tktk", "xxxx", "undefined",
    "dear", "hi [", "hi <", "hello", "hola", "bonjour", "hallo", "geehrte",
)
_SHORT = re.compile(r"%[A-Za-z_]{2,}%|\$[A-Za-z_]{2,}\$|__[A-Za-z_]{2,}__|[^\\${^_\w}]\{[A-Za-z_]{2,}\}|^\{[A-Za-z_]{2,}\}|<[A-Z]{2,} [A-Z]{2}")
_UPPER_ONLY = re.compile(r"(?:%[A-Za-z_]+%|\$[A-Za-z_]+\$|__[A-Za-z_]+__)$")
# Words before "undefined" where it is spoken of.
_TALK = set("is are was were be been left of a an the as stay stays remain remains return returns print prints show shows called named".split())

_FENCE = re.compile(r"^[ ]{0,3}(?:>[ ]?)*(?:[-*+][ ]+)?(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}(?:>[ ]?)*[ ]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_INDENTED = re.compile(r"(?:\A|(?<=\n\n)|(?<=\n))(?<!\w\n)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")
_CODE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?:\n[^\n]+?)??(?<!`)\1(?!`)|<(pre|code|script|style)\b[^>]*>.*?</\2>", re.S | re.I)
_MATH = re.compile(r"\$\$.+?\$\$|(?<![\\\w$])\$(?=[^\s$\d])(?![A-Za-z_]+\$)[^$\n]*?[\\^{}=+][^$\n]*\$(?!\w)", re.S)
_QUOTE = re.compile(r"“[^“”\n]*(?:\n[^“”\n]+)?”|„[^„“”\n]*[“”]|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]+\"")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)")
_WIKI = re.compile(r"!?\[\[[^\s\[\]][^\[\]\n]*\]\]")
_FRONT = re.compile(r"\A﻿?\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)

# Lines of navigation around a page.
CHROME = re.compile(
    r"home(?: *[|·•>/] *[\w ]+)+|sign in(?: *[|·•>/] *[\w ]+)*|back to the start page|table of contents|skip to content|(?:©|\(c\)|copyright) *\d* *[\w .-]*|all rights reserved\.?"
    r"|[-*+] *\[[^\]]*\]\([^)]*\)|menu|search|next|previous|untitled document|new page|sample page|beispielseite|page d'exemple|página de ejemplo|示例页面|サンプルページ|(?:section|chapter|heading|title) *\d*",
    re.I,
)

# Phrases of error pages.
ERRORS = """
error 0|error code 0|error code: 0|http error 0|status code 0|http 0|http/0.0 0|http/0 0|error:|fatal error|fatal error:
bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|precondition failed|payload too large|unsupported media type|i'm a teapot|unprocessable entity|too many requests
internal server error|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out|network authentication required|temporarily unavailable
0 bad request|0 unauthorized|0 forbidden|0 not found|0 request timeout|0 gone|0 internal server error|0 bad gateway|0 service unavailable|0 gateway timeout|0 too many requests
access denied|access to this page has been denied|permission denied|you don't have permission to access|you don't have permission to|to view this resource|this resource|you do not have permission|you are not allowed to|open this document|view this page|access this resource
page not found|file not found|the page you were looking for|the page you are looking for|the page you requested|does not exist|doesn't exist|doesn't exist.|could not be found|was not found on this server|the requested address|the requested url|the requested page|can't be found|cannot be found
the link may be broken|or the page may have moved|the page may have moved|may have been moved|or deleted|has been deleted|has been removed|the file you asked for|the document you asked for|the page you asked for
this content is not available|not available in your region|in your country|is currently unavailable|is not available right now|unavailable
the host|refused the connection|connection refused|connection timed out|connection reset|the renderer crashed|while building this page|while loading this page|the document store|is not reachable right now|is not reachable|could not be reached
an unexpected error|an unexpected condition|has occurred|occurred while|processing your request|something went wrong|an error occurred|an error has occurred|oops|whoops|sorry|sorry!|we're sorry|we are sorry
try a search|or go back to where you came from|go back to where you came from|go back to the home page|return to the home page|try again in 0 minutes|in 0 minutes|please try again later|please try again|try again later|try again|come back later|please come back later|our team has been told|our team has been notified|if this goes on|write to the administrator|contact the administrator|contact support
reload the page|refresh the page|code 0|request id: 0-0|request id:|request id|incident id|reference #0.0|reference #|ray id|the server could not complete your request|the server could not|complete your request|the server encountered|httpd/0.0.0|-httpd/0.0.0|server at|/0.0.0 server|nginx/0.0.0
error establishing a database connection|the upstream did not answer|upstream did not answer|ray id 0|database connection|database error|traceback (most recent call last):|traceback (most recent call last)|keyerror: 'title'|keyerror:|valueerror:|typeerror:|attributeerror:|exception in thread|stack trace:|file "|", line 0|, in render|in render|on line 0|not found in|template
rate limit exceeded|retry after 0 s|retry after|your session has expired|session has expired|session expired|sign in again to view this page|sign in again|please log in|log in again|we'll be back soon|down for maintenance|under maintenance|be right back|scheduled maintenance
{"error": {"code": 0|"error":|"code": 0|"message":|document could not be loaded|could not be loaded|request timed out after 0 seconds|request timed out|timed out after 0 seconds
checking your browser before|checking your browser|this may take 0 seconds|this may take a few seconds|cookies and scripts must be allowed|must be allowed|verify you are human|are you a robot|complete the captcha
es ist ein fehler aufgetreten|ein fehler ist aufgetreten|seite nicht gefunden|die angeforderte adresse|gibt es nicht|gibt es nicht (mehr)|fehler 0:|die seite wurde nicht gefunden|diese seite existiert nicht|die angeforderte seite|interner serverfehler|zugriff verweigert|fehler 0|nicht verfügbar|bitte versuchen sie es später
une erreur est survenue|une erreur s'est produite|page introuvable|page non trouvée|cette page n'existe pas|n'existe pas|la page demandée|la page que vous cherchez|erreur 0|accès refusé|accès interdit|erreur interne du serveur|erreur 0 :|le serveur n'a pas pu|traiter la demande|le serveur|veuillez réessayer
se ha producido un error|ha ocurrido un error|página no encontrada|compruebe la dirección|o vuelva al inicio|vuelva al inicio|la página no existe|la página solicitada|no se encuentra|no existe|error interno del servidor|acceso denegado|inténtelo de nuevo
si è verificato un errore|pagina non trovata|ocorreu um erro|página não encontrada|er is een fout opgetreden|pagina niet gevonden
страница не найдена|произошла ошибка|ошибка 0|ошибка|доступ запрещён|доступ запрещен|внутренняя ошибка сервера|запрошенная страница|не существует|попробуйте позже
出错了|您访问的页面不存在|页面不存在|页面未找到|找不到页面|找不到该页面|错误代码 0|错误代码|服务器内部错误|拒绝访问|请稍后再试|无法访问|（错误代码 0）
エラーが発生しました|ページが見つかりません|urlをご確認ください|お探しのページは|見つかりませんでした|アクセスが拒否されました|サーバーエラー|しばらくしてから|エラーコード
حدث خطأ|الصفحة غير موجودة|خطأ 0|لم يتم العثور على|غير متاح|त्रुटि हुई|एक त्रुटि हुई|पृष्ठ नहीं मिला|यह पृष्ठ मौजूद नहीं है|त्रुटि 0|เกิดข้อผิดพลาด|ไม่พบหน้า|ไม่พบหน้าที่คุณต้องการ|ข้อผิดพลาด 0
"""
# What pages say of themselves, by part: these parts cover a sentence only
# where a phrase of the other lists stands in it.
SUBJECTS = [
    f"{which} {what}"
    for which in ("this", "the", "that", "your", "the requested", "requested", "the page", "our")
    for what in "page site website content video account file document link post item resource product domain url address article session request service application server".split()
]
SUBJECTS += (
    "page|the page you requested|the page you have requested|the page you are looking for|you are looking for|you have requested|you requested|webseite|die seite|diese seite|seite|angeforderte|cette page|la page|page|demandée|que vous cherchez|esta página|esa página|la página|página|"
    "solicitada|que busca|questa pagina|pagina|richiesta|denna sida|sidan|sida|siden|side|sivu|sivua|strona|strony|stránka|stránku|požadovaná|oldal|a keresett|keresett|сторінка|сторінку|страница|страницу|запрашиваемая|sayfa|aradığınız|halaman|trang|이 페이지|페이지를|페이지|요청하신|お探しの|このページ|"
    "ページ|该页面|此页面|页面|您访问的|الصفحة|هذه الصفحة|التي تبحث عنها|पृष्ठ|यह पृष्ठ|หน้าที่คุณ|หน้าที่|หน้า|η σελίδα|σελίδα|longer|leider|nicht mehr|ya|plus|länge|längre|please|bitte|per favore|proszę|пожалуйста|будь ласка|your ip|ip address|due to inactivity|by its author|by the author"
).split("|")
STATES = """
cannot be displayed|has been blocked|have been blocked|was deleted|was removed|were removed|is out of stock|out of stock|logged out|have been logged out|unable to service|invalid hostname|server error|application error|runtime error|http status 0|could not find that page|we couldn't find|we could not find
introuvable|est introuvable|n'a pas été trouvée|n'a pas été trouvé|n'existe plus|konnte leider nicht gefunden werden|existiert nicht|existiert nicht mehr|no encontramos|ya no existe|non trovata|non esiste più|finns inte längre|findes ikke længere|neexistuje|не існує|찾을 수 없|غير موجودة|لم نتمكن من|ไม่พบหน้าที่
is not available|is unavailable|is currently not available|is no longer available|not available|no longer exists|has been suspended|has been disabled|has been moved|was not found|were not found|is private|has expired|timed out|is down|is offline
is parked|parked free|is for sale|is under construction|is under maintenance|is temporarily down|no results found|nothing was found|nothing found|can't be reached|cannot be reached|can’t be reached|could not be displayed|failed to load|unable to connect|unable to load
you need to log in|you must be logged in|please sign in|please log in|access is denied|attention required|just a moment|index of /|welcome to nginx|default page|it works!|just another|dns_probe|err_connection|uncaught error|uncaught exception|call to undefined|undefined variable|fatal error
sayfa bulunamadı|bulunamadı|bir hata oluştu|hata oluştu|erişim engellendi|yakında|yapım aşamasında|nie znaleziono|nie istnieje|nie została znaleziona|wystąpił błąd|brak dostępu|w budowie|wkrótce|không tồn tại|không tìm thấy|đã xảy ra lỗi|bị từ chối|đang xây dựng|sắp ra mắt
niet gevonden|bestaat niet|kan niet worden gevonden|is een fout opgetreden|geen toegang|in aanbouw|binnenkort|não foi encontrada|não existe|não encontrado|acesso negado|em construção|em manutenção|indisponível|non esiste|non è stata trovata|accesso negato|in costruzione|in manutenzione|non disponibile
kunde inte hittas|hittades inte|finns inte|ett fel uppstod|ett fel har inträffat|åtkomst nekad|under uppbyggnad|kommer snart|blev ikke fundet|ikke fundet|findes ikke|der opstod en fejl|adgang nægtet|under opbygning|kommer snart|ble ikke funnet|finnes ikke|det oppstod en feil|ei löydy|ei löytynyt|tapahtui virhe|pääsy estetty|tulossa pian
nebyla nalezena|nenalezena|neexistuje|došlo k chybě|přístup odepřen|ve výstavbě|již brzy|nem található|nem létezik|hiba történt|hozzáférés megtagadva|fejlesztés alatt|hamarosan|не знайдено|не існує|сталася помилка|доступ заборонено|в розробці|незабаром|nu a fost găsită|nu există|a apărut o eroare|acces interzis|în construcție|în curând
tidak ditemukan|tidak ada|terjadi kesalahan|akses ditolak|segera hadir|찾을 수 없습니다|존재하지 않습니다|오류가 발생했습니다|접근이 거부되었습니다|공사 중|준비 중|곧 공개|δεν βρέθηκε|δεν υπάρχει|παρουσιάστηκε σφάλμα|υπό κατασκευή|σύντομα|הדף לא נמצא|לא נמצא|אירעה שגיאה|בקרוב
no está disponible|no disponible|no se ha encontrado|en mantenimiento|ce contenu n'est pas disponible|n'est pas disponible|en maintenance|en construction|ist nicht verfügbar|wurde nicht gefunden|konnte nicht gefunden werden|wartungsarbeiten|im aufbau|im wartungsmodus|недоступен|недоступна|не найден|не найдена|на реконструкции|технические работы
维护中|正在维护|不可用|已被删除|已删除|不存在|无权访问|メンテナンス中|メンテナンス|削除されました|存在しません|利用できません|エラー|غير موجود|تحت الصيانة|उपलब्ध नहीं है|नहीं मिला|ไม่พร้อมใช้งาน|ไม่พบ
"""
SCRIPT_PARTS = """
unterstützt kein javascript|kein javascript|ne supporte pas javascript|ne prend pas en charge javascript|necesita javascript|necesitas habilitar javascript|habilitar javascript|włączyć javascript|włącz javascript|javascript etkin değil|javascript'in etkin|necessita de javascript|richiede javascript|kräver javascript|kræver javascript|vyžaduje javascript|javascriptが必要です|には
etkinleştirin|javascript'i etkinleştirin|włącz javascript|włącz obsługę|bật javascript|vui lòng bật|schakel javascript|javascript inschakelen|habilite o javascript|ative o javascript|abilita javascript|attiva javascript|aktivera javascript|slå på javascript|aktivér javascript|slå javascript til|povolte javascript|zapněte javascript|engedélyezze a javascriptet|увімкніть javascript
activați javascript|aktifkan javascript|자바스크립트를|활성화|사용하도록 설정|ενεργοποιήστε|הפעל javascript|в настройках|в настройках браузера|in den einstellungen|dans les paramètres|en la configuración|deaktiviert|désactivé|desactivado|が無効になっています|有効にして|javascript and cookies|cookies to continue|cookies must be enabled|aktivieren sie cookies|enable cookies|turn on cookies
"""
# Phrases of notices that scripts are needed.
SCRIPTS = """
javascript|java script|js|scripts|scripting|client-side scripting|client-side scripts|and cookies|cookies
please enable|please turn on|please switch on|please allow|please activate|enable|turn on|turn it on|switch|switch on|activate|allow it|allow|allow it for the full|for the full|experience
must be enabled|is required|are required|is needed|must be turned on|is disabled|is disabled in your browser|is blocked|is turned off|appears to be disabled|it looks like|you need to enable|you need to|you must enable|needs javascript|needs|requires javascript|requires|this page needs|this site needs|this app needs|this site requires|this app requires|this page requires
to continue|to run|to view this page|to read this page|to see this page|to load the document|to use the reader|to use this site|to use this app|to read the documentation of|to read the documentation|before the text can be shown|to proceed|to read on
in your browser settings|in your browser|in the browser|and reload|then reload|and refresh the page|and try again|use a supported browser|supported browser|your browser|your browser does not run scripts|your browser does not support|does not support|the viewer|the reader|cannot start
doesn't work properly without|does not work properly without|doesn't work without|works best with|switched on|enabled|we're sorry|we're sorry, but|without|loading…|loading...|loading|if nothing happens|on
bitte aktivieren sie javascript|javascript aktivieren|aktivieren sie|diese seite benötigt|benötigt javascript|um fortzufahren|um diese seite anzuzeigen|in ihrem browser|um die seite zu sehen|schalten sie|ein|bitte schalten sie javascript ein
veuillez activer javascript|veuillez activer|pour lire cette page|pour continuer|pour afficher cette page|activez javascript|dans votre navigateur|cette page nécessite
active javascript|habilite javascript|en su navegador|para continuar|para ver esta página|esta página necesita|esta página requiere|por favor, active javascript|active|abilita javascript|ative o javascript|schakel javascript in
включите javascript|для работы сайта|для просмотра|в браузере|в вашем браузере|включите|чтобы продолжить|необходим javascript|отключён|отключен
请启用 javascript|请启用javascript|请启用|启用 javascript|后刷新本页|刷新本页|以继续|请开启 javascript|需要启用|浏览器
このページを表示するには|javascriptを有効にしてください|を有効にしてください|有効にしてください|ブラウザ|ブラウザの設定で|が無効です
يرجى تفعيل javascript|يرجى تفعيل|لعرض هذه الصفحة|للمتابعة|في متصفحك|कृपया जावास्क्रिप्ट चालू करें|कृपया javascript सक्षम करें|जावास्क्रिप्ट|सक्षम करें|जारी रखने के लिए|โปรดเปิดใช้งาน javascript|กรุณาเปิดใช้งาน javascript|เพื่อดำเนินการต่อ|ในเบราว์เซอร์ของคุณ
"""
# Phrases of filler and dummy text.
FILLER = """
your heading|your subheading|your title|your text here|your text goes here|text goes here|body copy|describe the step|replace this paragraph with your own words|replace this text|write something here|write your text here|add your text here|insert text here|enter text here|add content here|content goes here|text to follow|image to follow|copy to come|placeholder paragraph|placeholder text|placeholder
sample text|dummy text|sample paragraph|filler text|this is sample text|this is dummy text|this is placeholder text|this is a test|click to edit this text|click here to edit|click to edit|delete this text|and add your own story|edit or delete it|then start writing|this is your first page|this is your first post|hello world|hello world!
this is a default page|created by the site builder|change it in the settings|type something…|type something|type something...|start typing|untitled|lorem ipsum|coming soon|under construction|this page is under construction|this page is empty|page intentionally left blank|this page is intentionally left blank|to be written|to be announced|to be done|content coming soon|watch this space|more to come|no content yet|no content
the quick brown fox jumps over the lazy dog|nothing to see here yet|just words to fill the box|nothing to see here
beschreibung folgt|inhalt folgt|text folgt|button label|content to be added later|to be added later|to be added|todo: write this page|todo|write this page|card title|link text|image caption|platzhaltertext|bitte ersetzen|dient nur als muster|dies ist ein blindtext|der nur platz füllt|blindtext|mustertext|beispieltext|hier steht ihr text|hier könnte ihr text stehen|demnächst verfügbar|demnächst|in kürze|folgt in kürze|hier folgt text
contenu à venir|remplacez ce texte par le vôtre|remplacez ce texte|par le vôtre|faux texte|texte d'exemple|texte factice|votre texte ici|saisissez votre texte|bientôt disponible|bientôt|à venir|prochainement|texte à remplacer
texto de ejemplo|texto de relleno|texto de prueba|su texto aquí|tu texto aquí|escriba aquí su texto|próximamente|en construcción|testo di esempio|texto de exemplo|em breve|prossimamente
这里是占位文字|用来测试版式|占位文字|占位文本|示例文本|此处为示例文字|此处填写内容|在此填写内容|此处填写|请填写内容|在此输入文字|请在此输入|敬请期待|即将推出|建设中|内容待补充
ダミーテキスト|サンプルテキスト|ここにテキストを入力|ここに文章を入力|これはダミーテキストです|近日公開|準備中|工事中
пример текста|текст-заполнитель|текст-рыба|рыба-текст|здесь будет текст|здесь будет ваш текст|скоро|скоро здесь|страница в разработке|замените этот текст|это просто текст
نص تجريبي|نص بديل|هذا نص تجريبي|قريبا|قريبًا|قيد الإنشاء|नमूना पाठ|यहाँ पाठ लिखें|जल्द आ रहा है|ข้อความตัวอย่าง|เร็วๆ นี้|ใส่ข้อความที่นี่
blah|asdf|jkl|qwer|zxcv|qwerty|foo|bar|baz|qux
"""
# Phrases of these lists that are ordinary words and prove nothing alone.
GENERIC = set(
    "on|ein|enable|active|allow|switch|turn on|switch on|without|enabled|switched on|template|scripts|cookies|the server|the reader|the viewer|to continue|to run|to proceed|in your browser|"
    "in the browser|your browser|aktivieren sie|schalten sie|activate|needs|requires|is required|are required|is needed|the host|in your country|this resource|le serveur|habilite|включите|в браузере|浏览器|ブラウザ".split("|")
)
# The words of the usual Latin dummy text.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum at vero eos accusam justo duo dolores rebum stet clita kasd gubergren no sea takimata sanctus "
    "integer nunc risus vestibulum pharetra congue vel lacus mauris vitae ultricies leo praesent elementum facilisis pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas "
    "aliquam erat volutpat donec fermentum purus massa tincidunt arcu cursus viverra ligula porttitor semper feugiat pretium nibh a urna ornare nec ante primis faucibus orci luctus ultrices posuere cubilia curae "
    "proin gravida hendrerit lectus quam id tellus cras interdum velit laoreet suspendisse potenti maecenas euismod neque condimentum mattis blandit nam libero phasellus egestas fringilla vivamus augue iaculis".split()
)

_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_TAGS = re.compile(r"</?(?:h[1-6]|p|div|b|strong|em|i|center|br|hr|body|html|title|noscript|span|main|section|font)\b[^<>]*>", re.I)
_ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？।])|\n+")
_MARK = re.compile(r"^(?:[>\s]*(?:#{1,6}\s+|[-*+]\s+(?!\[[^\]]*\]\()|\d+[.)]\s+)?)")
_WORD = re.compile(r"[^\W\d_]+")
#: Identifiers, paths and host names; they are neither for nor against residue.
_TECHNICAL = re.compile(r"[\w.\-]*(?:[_/\\]|\.(?=[a-z]))[\w./\\\-]*")


def _blank(m: re.Match) -> str:
    return " " * 3 + "\n" * m.group().count("\n")


def unquoted(text: str) -> str:
    """The text without code, quotations, math and link targets."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("\ufeff")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(_blank, text)
    if "    " in text or "\t" in text:
        text = _INDENTED.sub(_blank, text)
    if "`" in text or "<" in text:
        text = _CODE.sub(_blank, text)
    if "$" in text:
        text = _MATH.sub(" ", text)
    text = _QUOTE.sub(_blank, text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    return text


def has_placeholder(text: str) -> bool:
    """Whether an unfilled placeholder stands in the running text."""
    if next(hints().iter(text.lower()), None) is None and not (any(c in text for c in ("%", "$", "__", "{", "<")) and _SHORT.search(text)):
        return False
    text = _WIKI.sub(" ", unquoted(text))
    for m in PLACEHOLDERS.finditer(text):
        found = m.group()
        if _UPPER_ONLY.match(found) and not found.isupper():
            continue
        if found[0] in "xX" and not found.isupper():
            continue
        if found.lower() == "undefined" and (_word_before(text, m.start()) in _TALK or found != "undefined"):
            continue
        if found[0] == "<" and found[1:2].isalpha() and not found.isupper() and not found.lower().startswith(("<insert", "<your", "<enter", "<add", "<fill")):
            continue
        return True
    return False


def _word_before(text: str, at: int) -> str:
    """The word that ends before the white space in front of ``at``, in small letters."""
    stop = at
    while stop and text[stop - 1].isspace():
        stop -= 1
    start = stop
    while start and text[start - 1].isalpha():
        start -= 1
    return text[start:stop].lower() if stop < at else ""


@lru_cache(maxsize=1)
def hints() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for hint in _HINTS:
        own.add_word(hint, hint)
    own.make_automaton()
    return own


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for subject in map(_fold, SUBJECTS):
        own.add_word(subject, (len(subject), False))
    for block in (ERRORS, STATES, SCRIPTS, SCRIPT_PARTS, FILLER):
        for phrase in filter(None, map(_fold, block.strip().replace("\n", "|").split("|"))):
            own.add_word(phrase, (len(phrase), phrase not in GENERIC))
    own.make_automaton()
    return own


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    return _SPACE.sub(" ", _DIGITS.sub("0", text.casefold().replace("’", "'").replace("‘", "'"))).strip()


def _covered(sentence: str) -> int:
    """Characters of a folded sentence that phrases of the automaton cover; 0 where all of
    them are generic."""
    spans, strong = [], False
    for end, (n, proves) in automaton().iter(sentence):
        start = end - n + 1
        wide = sentence[start].isascii() and sentence[start].isalnum() and start and sentence[start - 1].isalnum()
        tail = sentence[end].isascii() and sentence[end].isalnum() and end + 1 < len(sentence) and sentence[end + 1].isascii() and sentence[end + 1].isalnum()
        if not wide and not tail:
            spans.append((start, end + 1))
            strong |= proves
    if not strong:
        return 0
    done, upto = 0, 0
    for start, end in sorted(spans):
        done += max(0, end - max(start, upto))
        upto = max(upto, end)
    return done


def _is_filler(folded: str, title: bool) -> bool:
    """Latin dummy text or its kin that begin with a word and "ipsum"; one letter, or few
    words, over and over."""
    words = _WORD.findall(folded)
    if not words:
        return False
    if len(words) > 1 and (words[1] == "ipsum" or sum(w in LATIN for w in words) >= 0.8 * len(words)):
        return True
    if len(words[0]) > 2 and words[0] == words[0][0] * len(words[0]) and all(len(set(w)) == 1 and len(w) > 2 for w in words):
        return True
    return not title and len(words) > 6 and len(set(words)) * 4 <= len(words)


def is_residue_body(text: str) -> bool:
    """Whether the body is filler, an error page or message, or a script notice."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    raw = _FRONT.sub("", text)
    if "```" in raw or "~~~" in raw:
        raw = _FENCE.sub(_blank_marked, raw)
    raw = _folded_lines(_TAGS.sub(" ", raw) if "<" in raw else raw)
    residue = body = total = 0
    lead = None
    units: Counter = Counter()
    left = len(raw)
    for paragraph, title in _paragraphs(raw):
        left -= len(paragraph)
        if title and CHROME.fullmatch(paragraph.strip("*_> ")):
            continue
        for part in _ENDS.split(_MARK.sub("", paragraph) if title else paragraph):
            folded = " ".join(part.split()).strip("*_~#>|- \t")
            if not folded or CHROME.fullmatch(folded) and not title:
                continue
            n = len(folded)
            bare = folded.rstrip(".!?…。！？। ")
            covered = _covered(folded)
            if lead is None and n > 3:
                lead = covered >= 0.9 * len(bare)
            bad = bool(covered) and bool(bare) and covered >= SENTENCE_SHARE * max(len(_TECHNICAL.sub("", bare)), 4)
            bad = bad or _is_filler(folded, title) or title and folded == "0"
            if bad:
                residue += n
            elif not title:
                body += n
            if not title:
                units[folded] += n
                total += n
        # What is left cannot make residue prevail over the body read so far: stop.
        most = residue + left
        if len(units) > 4 and most < BODY_SHARE * (most + body) and not (lead and body <= 3 * most):
            return False
    if residue and (residue >= BODY_SHARE * (residue + body) or lead and body <= 3 * residue and residue + body <= SHORT_PAGE):
        return True  # a short body under a bare error message is an error page as well
    if total > 150:
        top = sum(n for u, n in units.items() if n >= 4 * len(u))
        return top >= 0.85 * total and len(units) <= 4
    return False


def _folded_lines(text: str) -> str:
    """``_fold`` of a text that keeps its lines."""
    text = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    return _DIGITS.sub("0", text.casefold().replace("’", "'").replace("‘", "'"))


def _paragraphs(raw: str) -> Iterator[tuple[str, bool]]:
    """(text, stands alone): headings and navigation alone, other lines as paragraphs, as
    a sentence may run over a line break."""
    held: list[str] = []
    for line in raw.split("\n"):
        line = line.strip()
        alone = not line or line.lstrip("> ").startswith("#") or len(line) < 120 and CHROME.fullmatch(line.strip("*_ ")) is not None
        if not alone:
            held.append(_MARK.sub("", line) if line[0] in "#>-*+0123456789" else line)
            continue
        if held:
            yield " ".join(held), False
            held = []
        if line:
            yield line, True
    if held:
        yield " ".join(held), False


def _blank_marked(m: re.Match) -> str:
    return "\ncode block standing here as content of the document\n"


def is_residue(text: str | None) -> bool:
    """The whole test; null, empty and blank texts are no cases."""
    if not text or text.isspace():
        return False
    return has_placeholder(text) or is_residue_body(text)


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct ids of documents to exclude.

    Rows without an id, and null, empty or blank texts, are never returned; other columns
    are ignored.  Texts are read whole and nothing but the found ids is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [is_residue(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=[id_col])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return spread(rows, id_col).mapInArrow(run, f"`{id_col}` {kind}").distinct()
