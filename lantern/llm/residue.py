"""Template residue and error-page text (problem 10).

Method: messages are mined into templates with a prefix tree of fixed depth (number of words, first
words, then the words that classify with their places). A leaf is one template, whose slots are the
places where its messages differ; leaves meet by key in a shuffle, so neither the templates nor
their support depend on how the corpus is split. Each template is classified once, by its wording or
by how dense its cues are, how often it occurs and how often it is all there is, and the verdict is
propagated by a join on the leaf to every record that holds a message of it. Slots that nobody
filled in stand in messages of any wording, so they are looked for separately in each record. Code
and quotations are masked before either, because a record may write about such things.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Callable, Iterator
from re import _parser

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: First words that choose the branch of the tree.
DEPTH = 4
#: Templates with a verdict that are broadcast, most frequent first; the others are joined by a shuffle.
BLOCK = 100_000
#: A template without known wording is residue if this share of its words are cues (two at least), it
#: has at most so many words, occurs so often, and such a share of its occurrences is a whole text.
DENSE, LONGEST, SUPPORT, ALONE = 0.5, 15, 3, 0.3

# The wording of stored messages, fillers and notices, in the languages they come in.
STATUS = r"bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file |post |url )?not found|method not allowed|not acceptable|request time-?out|gone|payload too large|too many requests|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|permission denied|seite (?:wurde )?nicht gefunden|zugriff verweigert|interner serverfehler|page (?:non trouvée|introuvable)|accès (?:refusé|interdit)|página no encontrada|acceso denegado|página não encontrada|acesso negado|pagina non trovata|accesso negato|pagina niet gevonden|nie znaleziono strony|страница не найдена|доступ запрещ[её]н|ページが見つかりません|页面(?:未找到|不存在)"
ERRORS = r"error|fehler|erreur|errore|erro|fout|błąd|ошибка|エラー|错误"
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum fusce vitae vestibulum ante primis".split())
#: Lorem words that are also words of living languages count only beside the others.
SHARED = set("do in ex ad id est non et ut sed sit qui do ea eu ante sunt elit sint esse".split())
SCRIPTS = r"(?:java ?-?script|ecmascript|\bjs\b|(?:client-side )?script(?:s|ing)?(?: execution)?|noscript)"
DEMANDS = r"enable|enabling|activat\w*|turn on|turn\w* .{0,20} on|switch\w* .{0,8}on|allow|requires?|needs?|must|please|unblock|blocks?|blocked|does not (?:run|support|allow)|do not (?:run|support)|disabled|deaktiviert|aktivier\w*|einschalten|erlauben|benötigt|activer|activez|autoris\w*|nécess\w*|turned off|switched off|not enabled|ausgeschaltet|désactivé|activ[ae]r?\b|habilit\w*|permit\w*|requiere|abilit\w*|attiv\w*|inschakelen|włącz\w*|включ\w*|разреш\w*|有効|启用|允许"

_FILLER = regex.compile(
    r"""(?:
      (?:your|some|sample|placeholder|dummy|example|default)\s(?:\w+\s)?(?:text|title|content|name|description|message)(?:\s(?:goes\s)?here)?
    | (?:the\s)?[\w\s'-]{0,60}\b(?:goes|go)\shere | insert\s[\w\s-]{1,40}(?:\shere)? | enter\s(?:your\s)?[\w\s-]{1,30}\shere | type\s[\w\s-]{0,30}here | click\shere\sto\s(?:add|edit)[\w\s-]{0,30}
    | (?:write|say|tell\sus|add|put)\s(?:something|a\slittle|your\s\w+|text|content)[\w\s-]{0,40}(?:here|yourself|below\sthis\sline) | add\syour\s\w+\sbelow[\w\s]{0,20}
    | (?:no|empty)\s(?:content|description|text|body)(?:\syet)?(?:[,;]?\s(?:fill\sin|add|edit)[\w\s]{0,20})? | (?:to\sbe|tba|tbd|tbc)(?:\s(?:done|written|determined|announced|completed|tba|tbd|tbc))*
    | (?:(?:tag|post|user|question|answer)\s)?(?:description|excerpt|body|text|content|summary|title|biography|bio|wiki)\s(?:is\s)?(?:pending|missing|coming\ssoon|to\sfollow|unavailable|not\sset) | coming\ssoon | under\sconstruction | work\sin\sprogress
    | (?:todo|fixme|tbd)\b\s?[:,-]?\s?(?:(?:write|add|fill|insert|describe|describ\w+|complete|update|replace)\b[\w\s<>*-]{0,60})? | replace\s(?:this|me)\b[\w\s]{0,40} | (?:this\sis\s)?(?:a\s)?(?:placeholder|dummy|filler)(?:\s(?:text|content|post))? | x{3,}
    )""",
    regex.X,
)
_STRONG = [
    regex.compile(p)
    for p in (
        rf"(?:oops|sorry|{ERRORS}|http\S*|status|<\*>|[\W_])*(?:<\*>|{ERRORS}|http\S*)[\W_]*(?:{STATUS})[\W_]*(?:<\*>|{ERRORS}|[\W_])*",
        rf"(?:oops|sorry|{ERRORS}|[\W_])*(?:{STATUS})[\W_]*(?:<\*>|{ERRORS})[\W_]*",
        r".*\b(?:post|page|answer|question|thread|comment|content|article|file|site|url|address|link|topic|resource|document)\b.{0,40}\b(?:(?:could|can) ?not be (?:found|loaded|displayed|shown|opened|reached)|not found on this server|does(?: not|n't) exist|no longer (?:exists?|available)|(?:has|have|been|was|were) (?:moved|removed|deleted)\b.{0,30}\b(?:or|and|changed|address|never)).*",
        r".*\b(?:we|server|system|site|it)\b.{0,6}\b(?:could not|couldn't|were unable to|was unable to|cannot|can't|failed to) (?:find|load|display|show|open|fetch|retrieve|process your|complete your|reach)\b.{0,20}\b(?:post|page|answer|question|thread|comment|content|article|file|site|request|resource|document)s?\b.*",
        r".*\b(?:down|closed|offline|unavailable) (?:for|due to) (?:scheduled )?maintenance\b.*",
        r".*\byour (?:ip|address|ip address|access|account|request) (?:was|has been|is|were) (?:temporarily )?(?:blocked|banned|denied|refused|suspended|limited|rejected)\b.*",
        r".*\b(?:upstream|mirror|server|backend|host|gateway|proxy)\b.{0,40}\b(?:gave no|no|did not|didn't|failed to|not) (?:answer|response|respond|reply|send)\b.*",
        r"(?:no|the) server is (?:available|unavailable|busy|overloaded|temporarily)\b.*",
        r"(?:your )?session (?:has )?(?:expired|timed out|ended)\b.*",
        r"(?:please )?(?:log ?in|sign in|log on)(?: again| first)? to (?:read|view|see|continue|access|show)\b.*",
        r"(?:access|permission) (?:is )?denied[\W_]*(?:<\*>[\W_]*)?",
        r"you (?:do not|don't) have (?:the )?(?:permission|rights?|access|privileges?)\b.*",
        r"you are not (?:authori[sz]ed|allowed|permitted)\b.*",
        r"(?:the )?connection (?:was|has been|is) (?:reset|refused|closed|lost|interrupted|aborted|timed out)\b.*",
        r"(?:fatal error|parse error|uncaught \w+|unhandled \w+)\b[\s:].*",
        r"(?:warning|notice|error|deprecated)\s?:.*\b(?:undefined|cannot|line <\*>|failed to|division by|in \S+\.(?:php|py|tpl|js|asp)\b).*",
        r"[\W_]*http error <\*>.*",
        r"[\W_]*(?:script|request|page|query|database|server) time-?(?:d )?out\b.*",
        r".*\bpage incomplete\b.*",
        r"[\W_]*error (?:while )?(?:loading|fetching|rendering|retrieving|displaying) (?:the )?(?:rest|remaining|content|page|post|answer|question|comment|data|text|body)\b.*",
        r"[\W_]*(?:failed|unable) to (?:load|fetch|render|retrieve|display) (?:the )?(?:rest|remaining|content|page|post|answer|question|comment|data|text|body|thread)\b.*",
        r"error establishing a database connection.*",
        r".*\bchecking (?:if the site connection is secure|your browser before)\b.*",
        r".*\b(?:complete|solve) the captcha\b.*",
    )
]
_WEAK = [
    regex.compile(p)
    for p in (
        rf"(?:oops|sorry|{ERRORS}|[\W_])*(?:{STATUS})[\W_]*",
        rf"(?:{ERRORS})[\W_]*(?:<\*>)?[\W_]*",
        r".*\b(?:please )?(?:try|reload|refresh|come back)\b.{0,30}\b(?:again|later|page|soon)?[\W_]*",
        r"(?:please )?(?:go|return|get) (?:back )?to the (?:start|home|front|main|previous) ?page[\W_]*",
        r"(?:request|reference|error|incident|support|trace|ray)(?: (?:id|no|number|code))?[\s:#.]*\S*<\*>[\W_]*",
        r"if this (?:goes on|persists|continues|happens again).*",
        r"(?:please )?(?:activate|enable|turn on|allow) (?:both|them|it|this)\b.{0,30}",
        r"traceback \(most recent call last\)[\W_]*",
        r"file \S+.*\bline <\*>.*",
        r"\w*(?:error|exception): .*",
        r"maybe .{0,60}\b(?:removed|changed|moved|deleted)\b.*",
        r"(?:oops|sorry|something went wrong|an error (?:has )?occurred)[\W_]*",
        r"(?:undefined|null|none|nan|n/a|\[object object\]|[\W_])+",
    )
]
# Whole messages by what they speak of and what became of it, weak until the tree says that they recur.
_OF = r"(?:page|site|website|web ?page|web ?site|server|service|resource|content|post|answer|question|thread|topic|comment|video|image|file|document|url|link|application|app|system|location|section|article)"
_OPEN = r"(?:(?:sorry|oops|whoops|unfortunately|hmm)[\W_]*)?(?:we're sorry,? but )?(?:it (?:looks|seems) like |looks like |it appears that )?"
_THE = r"(?:(?:the|this|that|your|our|an?) )?(?:(?:requested|following|linked) )?"
_END = r"(?: (?:in|on|at|by|right|for|anymore|any more|now|yet|due|to)\b.{0,60})?[\W_]*"
_BROAD = [
    regex.compile(p)
    for p in (
        rf"{_OPEN}{_THE}{_OF}(?: you \w+(?: \w+){{0,2}})? (?:is|are|was)(?: currently| temporarily)? (?:not available|unavailable|not working|not found|not responding|not loading|offline){_END}",
        rf"{_OPEN}{_THE}{_OF}(?: you \w+(?: \w+){{0,2}})? (?:isn't|aren't) (?:available|working|loading|responding){_END}",
        rf"{_OPEN}{_THE}{_OF}(?: you \w+(?: \w+){{0,2}})? (?:doesn't|does not|no longer) exists?{_END}",
        rf"{_OPEN}{_THE}{_OF}(?: you \w+(?: \w+){{0,2}})? (?:can't|cannot|can not|couldn't|could not) be (?:reached|found|displayed|loaded|opened){_END}",
        rf"{_OPEN}{_THE}{_OF}(?: you \w+(?: \w+){{0,2}})? (?:has been|may have been|was) (?:removed|deleted|suspended|disabled|moved|archived){_END}",
        rf"{_OPEN}{_THE}{_OF}(?: you \w+(?: \w+){{0,2}})? (?:has )?encountered an? .{{0,30}}error.{{0,60}}",
        rf"{_OPEN}(?:nothing was found|something (?:went wrong|broke|is broken|has gone wrong)).{{0,40}}",
        rf"{_OPEN}(?:an? |the )?(?:(?:internal|unexpected|unknown|application|fatal|system|server|network|runtime|temporary) )?(?:error|exception) (?:has |have )?(?:occurred|happened)\b.{{0,60}}",
        r"(?:application|server|system|network|runtime|internal|unexpected) (?:error|exception)\b:?.{0,60}",
        rf"{_OPEN}you (?:have been|were) (?:temporarily )?(?:blocked|banned|logged out)\b.{{0,60}}",
        rf"{_OPEN}(?:this|your) (?:account|profile|ip|access) (?:has been|is|was) (?:temporarily )?(?:suspended|disabled|locked|deactivated)\b.{{0,40}}",
        r"(?:rate|quota|bandwidth|request) limit (?:was |has been )?(?:exceeded|reached)\b.{0,30}",
        r"too many (?:redirects|attempts|connections|login attempts)\b.{0,30}",
        r"(?:invalid|expired|invalid or expired) (?:token|session|csrf token|api key)\b[\W_]*",
        rf"{_OPEN}(?:your |the )?(?:connection|request|operation|session)(?: to .{{0,40}})? (?:has )?timed out\b.{{0,30}}",
        r"(?:the )?(?:gateway|proxy|server|upstream|backend) (?:returned|answered|replied|responded)\b.{0,50}",
        rf"(?:please )?(?:verify|verifying|confirm|checking) (?:that |if )?(?:you are|you're) (?:human|not a robot)\b.{{0,40}}",
        r"just a moment[\W_]*",
        r"(?:please )?(?:complete|pass) the security check\b.{0,60}",
        r"you must (?:be logged in|be signed in|log in|sign in) to \w+.{0,40}",
        r".{0,60}\bunusual traffic from your\b.{0,60}",
        r"(?:fehler beim|fehler bei der) (?:laden|öffnen|verarbeit\w*|anfrage)\b.{0,40}",
        r"(?:diese |die )?(?:seite|website|datei) (?:ist )?(?:derzeit |zurzeit |momentan )?nicht (?:verfügbar|erreichbar)[\W_]*",
        r"erreur (?:lors|pendant) d\w+ .{0,40}",
        r"(?:cette |la )?page (?:n'est pas disponible|n'existe (?:pas|plus)|est indisponible)\b.{0,30}",
        r"no se (?:ha podido|pudo|puede) (?:cargar|encontrar|mostrar|abrir) (?:la|el|esta|este) (?:página|sitio|contenido)\b.{0,30}",
        r"(?:esta |la )?página no (?:está disponible|existe)\b.{0,30}",
        r"(?:esta |a )?página não (?:está disponível|existe)\b.{0,30}",
        r"(?:questa |la )?pagina non (?:è disponibile|esiste)\b.{0,30}",
        r"(?:deze )?pagina (?:is niet beschikbaar|bestaat niet)\b.{0,30}",
        r"(?:страница|сайт|сервер) (?:недоступ\w+|не существует|не отвечает)\b.{0,30}",
        r"(?:this is )?(?:an? )?(?:dummy|sample|example|placeholder) (?:text|page|post|paragraph|entry)(?: for .{0,40})?[\W_]*",
        r"(?:hello world[\W_]*)?(?:welcome to \w+[\W_]*)?this is your first (?:post|page)\b.{0,60}",
        r"welcome to wordpress[\W_]*",
        r"(?:no|keine?|aucune?) (?:description|excerpt|biography|beschreibung)(?: is)? (?:available|provided|vorhanden|disponible)[\W_]*",
        r"(?:text|content|description|excerpt|title|details|body)(?: is| are)? (?:to be|will be|yet to be) (?:added|inserted|written|provided|completed|supplied)\b.{0,30}",
        r"edit this (?:paragraph|text|section|template)\b.{0,40}",
        r"(?:this )?(?:page|section|field|space) (?:is |was |has been )?(?:intentionally|deliberately) (?:left )?blank[\W_]*",
        r"(?:blindtext|fülltext|platzhaltertext|texto de relleno|texte de remplissage|testo segnaposto)[\W_]*",
    )
]
_TALK = regex.compile(r"\b(?:i|my|me|mine|i'm|i've|i'd|ich|mein\w*|je|mon|mes|mi|meu|minha)\b|\?")
_CUE = regex.compile(
    rf"(?:{STATUS})|{ERRORS}|warning|fatal|traceback|exception|maintenance|blocked|banned|time-?d? ?out|expired|permission|connection (?:was|has|is)|upstream|mirror|server|session|log ?in|sign in|could ?not|couldn't|cannot|unable|failed|no longer|does(?: not|n't) exist|remov|moved|deleted|incomplete|captcha|checking|try again|later|reload|start page|home ?page|request id|reference|oops|sorry|undefined|null|none|nan\b"
    rf"|{SCRIPTS}|скрипт|スクリプト|脚本|cookies?|lorem|ipsum|dolor|consectetur|aliqu|\bhere\b|pending|missing|soon|todo|fixme|tb[acd]\b|placeholder|dummy|filler|sample|construction|x{{3,}}|content|below|blah|foo|asdf|test|text|\bline \d|\b(?:{'|'.join(sorted(LOREM - SHARED))})\b"
)
# Further English words that a template never generalises.
CUES = LOREM - SHARED | set(
    """error errors warning notice deprecated fatal traceback exception maintenance blocked banned refused suspended limited rejected timeout timed time expired permission rights access connection upstream mirror server backend host
    proxy session log login sign could couldn't cannot can't unable failed longer exist exists doesn't removed moved deleted changed never incomplete captcha checking try again later reload refresh back page home homepage start
    request reference incident support trace ray oops sorry something wrong occurred undefined null none nan n/a javascript java js script scripts scripting ecmascript noscript cookie cookies here pending missing soon todo
    fixme tbd tba tbc placeholder dummy filler sample construction progress content below yourself blah foo asdf test text line file unauthorized unauthorised forbidden found gone gateway unavailable required allowed
    authorized authorised permitted acceptable large many implemented denied bad persists continues happens goes maybe activate enable follow set coming replace fill database loading fetching insert empty""".split()
)


_SCRIPT = regex.compile(SCRIPTS + r"|скрипт|スクリプト|脚本")
_DEMAND = regex.compile(rf"(?:{DEMANDS})")
_WORD = regex.compile(r"[\p{L}\p{N}'/]+")
_ASCII_WORD = re.compile(r"[A-Za-z0-9'/]+")

#: The words by which verdicts are given; a template never generalises them.
KEPT = frozenset(w for source in (STATUS, ERRORS, SCRIPTS, DEMANDS, *(p.pattern for p in (_FILLER, _CUE, *_STRONG, *_WEAK, *_BROAD))) for w in regex.findall(r"\p{L}{2,}", source)) | LOREM | CUES
# Who speaks must outlive generalising as well.
TALK = frozenset("i my me mine i'm i've i'd ich je mon mes mi meu minha".split())


def _needed(pattern: str, flags: int = 0, most: int = 48) -> frozenset[str]:
    """Strings of which every match of a pattern holds one, empty where there is no such set.

    Derived from the parsed pattern: strings are joined along a sequence as long as there are at
    most `most`, and of the sets along it the one with the longest strings is taken. Slots and
    question marks end a string, since a message has other characters there than its template.
    """

    def least(strings: set[str]) -> set[str]:
        return {x for x in strings if not any(y != x and y in x for y in strings)}

    def worth(strings: set[str] | None) -> tuple[int, int]:
        return (-1, 0) if not strings else (min(map(len, strings)), -len(strings))

    def sequence(parts) -> tuple[set[str] | None, set[str] | None]:
        whole, best, at = True, None, {""}
        for part in parts:
            exact, need = node(*part)
            if exact is not None and len(at) * len(exact) <= most:
                at = {x + y for x in at for y in exact}
                continue
            whole = False
            best = max(best, at, need, key=worth)
            at = {""} if exact is None else exact
        return (at, at) if whole else (None, max(best, at, key=worth))

    def node(op, x) -> tuple[set[str] | None, set[str] | None]:
        """The strings a part can be, if they are few, and those of which it holds one."""
        op = str(op)
        if op == "LITERAL":
            return (None, None) if chr(x) in "<*>?" else ({chr(x)}, {chr(x)})
        if op == "AT":
            return {""}, {""}
        if op == "SUBPATTERN":
            return sequence(x[-1])
        if op == "IN" and all(str(o) == "LITERAL" and chr(c) not in "<*>?" for o, c in x):
            return ({chr(c) for _, c in x},) * 2
        if op == "IN" and [str(c) for _, c in x] == ["CATEGORY_SPACE"]:
            return {" "}, {" "}
        if op == "BRANCH":
            exact, need = zip(*map(sequence, x[1]))
            return set().union(*exact) if None not in exact else None, set().union(*need) if all(worth(n)[0] > 0 for n in need) else None
        if op == "MAX_REPEAT":
            low, high, inner = x
            exact, need = sequence(inner)
            if low == 0:
                return (exact | {""}, {""}) if high == 1 and exact is not None else (None, None)
            if exact is None or len(exact) ** low > most:
                return None, need
            again = {""}
            for _ in range(low):
                again = {a + b for a in again for b in exact}
            return (again if low == high else None), again
        return None, None

    found = sequence(_parser.parse(pattern, flags))[1]
    return frozenset(least(found)) if worth(found)[0] > 0 else frozenset()


#: What a message with a verdict must hold one of. The alternative of no word in _WEAK is tested apart.
NEEDED = [_needed(p.pattern.replace(r"|[\W_])+", ")+")) for p in (*_STRONG, *_WEAK, *_BROAD)] + [_needed(_FILLER.pattern, _parser.SRE_FLAG_VERBOSE)]
if not all(NEEDED):
    raise ValueError("a pattern has no word by which its messages are found")
_ANY = tuple(x for n in [frozenset().union(*NEEDED)] for x in sorted(n, key=len) if not any(y != x and y in x for y in n))
_ANY_SCRIPT, _ANY_DEMAND = tuple(_needed(_SCRIPT.pattern)) + ("cookies",), tuple(_needed(DEMANDS))
_LETTER = regex.compile(r"[^\W_]")


def _finder() -> Callable[[str], bool]:
    """Whether a string holds one of _ANY; by automaton where the library is there."""
    if ahocorasick is None:
        return lambda s: any(x in s for x in _ANY)
    machine = ahocorasick.Automaton()
    for x in _ANY:
        machine.add_word(x, 1)
    machine.make_automaton()
    return lambda s: next(machine.iter(s), None) is not None


_has_any = _finder()


def may_classify(segment: str) -> bool:
    """Whether a message, or a template that it joins, can get a verdict at all (see verdict and judge).

    True for every message with one; cheap enough for every message.
    """
    if _has_any(segment):
        return True
    if any(x in segment for x in _ANY_SCRIPT) and any(x in segment for x in _ANY_DEMAND):
        return True
    # Two cues, which are also fewer than any lorem needs.
    if sum(map(CUES.__contains__, (_ASCII_WORD if segment.isascii() else _WORD).findall(segment))) >= 2:
        return True
    # What is left are repeated words and messages of none. The words that no template of the message
    # generalises are those of the first words and of the words that classify.
    words = segment.split()
    if len(set(words[:DEPTH])) == DEPTH and all(map(str.isalpha, words[:DEPTH])):
        return False
    fixed: list[str] = []
    for n, w in enumerate(segment.replace("?", " ? ").split()):
        if not any(c.isdigit() for c in w):
            own = _WORD.findall(w)
            if n < DEPTH or not KEPT.isdisjoint(own):
                fixed += own
        if len(set(fixed)) > 3 and any(map(_LETTER.search, fixed)):
            return False
    return len(words) > DEPTH or len(fixed) >= 2 * len(set(fixed)) or not any(map(_LETTER.search, fixed))


_FENCE = regex.compile(r"```.*?(?:```|\Z)|~~~\n.*?(?:\n~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|<kbd\b.*?(?:</kbd>|\Z)|<blockquote\b.*?(?:</blockquote>|\Z)|``[^\n]*?``|`[^`\n]*`", regex.S | regex.I)
_INDENT = regex.compile(r"(?m)(?:(?<=\n\n)|\A)(?: {4}|\t\t)[^\n]*(?:\n(?: {4}|\t)[^\n]*)*|^\s*(?:>|&gt;)[^\n]*$")
_QUOTE = regex.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»|&quot;(?:(?!&quot;)[^\n]){1,200}&quot;")
_BREAK = regex.compile(r"<!--.*?(?:-->|\Z)|</?(?:p|div|br|hr|h\d|li|ul|ol|tr|td|th|table|title|head|body|html|noscript|section|article|header|footer)\b[^<>]*>", regex.S | regex.I)
_HTML = "a|abbr|acronym|address|article|aside|b|base|bdi|bdo|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|fieldset|figcaption|figure|font|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|map|mark|meta|nav|noscript|object|ol|optgroup|option|p|param|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|summary|sup|table|tbody|td|textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|audio|canvas|svg|path|source"
_TAG = regex.compile(rf"</?(?:{_HTML})\b[^<>]*/?>", regex.I)
# Where messages end: at the start of a match, after the one character of end or of full.
_SENTENCE = regex.compile(r"\n+|(?P<end>[.!?:;…])[)\]\"”»]*\s+(?=[\p{Lu}\p{Lo}\"“«(\[<{])|(?P<full>[。！？])|(?<=\s)(?=(?:Fatal error|Parse error|Warning|Notice|Traceback \(most|HTTP error \d|Script timeout)\b)")
_WRAP = regex.compile(r"^(?:\W|_)*(?:(?:edit|update|re|bump|thanks|thx|\+1|title|body|score|note|ps|solved|crosspost|reposted from chat|fyi)\b(?:\W|_)*)*", regex.I)
_TRAIL = regex.compile(r"(?:\s*(?:\+1|\(crosspost\)|thanks[.!]?|thx|bump[.!]?))+\s*$", regex.I)

_TRAILERS = ("+1", "(crosspost)", "thanks", "thx", "bump")

_ID = r"[\p{L}_][\p{L}\p{N}_]*"
_DOTTED = rf"{_ID}(?:[.| -]{_ID})*"
_UPPER = r"\p{Lu}[\p{Lu}\p{N}]*(?:[_ ][\p{Lu}\p{N}]+)*"
_SLOT = regex.compile(
    rf"""(?<![\w\]\)$\\]) (?:
      \{{\{{\{{? \s* [#/!&>^]? \s* {_DOTTED} (?:\s*[|:]\s*[^{{}}\n]{{0,40}})? \s* \}}?\}}\}}
    | \{{% [-\s]* {_DOTTED} [-\s]* %\}}
    | [\$\#] \{{ \s* {_DOTTED} \s* \}}
    | (?:<|&lt;)% [=-]? \s* {_DOTTED} \s* -? %(?:>|&gt;)
    | \[\[ \s* {_DOTTED} \s* \]\]
    | %% {_UPPER} %% | % (?=[\p{{Lu}}_ ]{{3}}) {_UPPER} % | %\( {_DOTTED} \) [sdif]
    | @@ {_UPPER} @@ | ~~ {_UPPER} ~~ | \$ (?=[\p{{Lu}}_ ]{{3}}) {_UPPER} \$
    | __ (?!(?:FILE|LINE|FUNCTION|INIT|NAME__\s*==|MAIN|NOTE|EDIT|UPDATE|WARNING|IMPORTANT)__) {_UPPER} __
    | \{{ !? (?=\w{{3}}) {_DOTTED} \}}
    | (?:<|&lt;) (?!/?(?:{_HTML})\b[^<>]*(?:>|&gt;)) (?:your\s{_ID} | {_UPPER} | [a-z]+(?:[_.][a-z]+)+ | (?:name|username|user|email|date|author|owner|count|excerpt|community|topic|thread|signature|badge|moderator|tag|insert\s[\w ]+)) (?:>|&gt;)
    | \[ (?!(?:OK|INFO|WARN|WARNING|ERROR|DEBUG|FATAL|TRACE|SOLVED|EDIT|UPDATE|UPDATED|CLOSED|DUPLICATE|PDF|SIC|NOTE|DRAFT|WIP|TODO|NSFW|OC|AMA|UTC|FAIL|PASS|PASSED|FAILED|DONE)\]) (?=[\p{{Lu}}_ ]{{3}}) {_UPPER} \] (?!\()
    | \[ (?i:insert|enter|your|add|fill\sin)\s[\w ]{{1,40}} \] | \( {_DOTTED} \s (?i:goes\shere) \) | \(?(?i:insert)\s[\w ]{{1,30}}\s(?i:here)\)?
    | \[ (?i:(?:(?:customer|client|first|last|full|user|your|company|recipient|sender|contact)[ _-]?)?name|vorname|nachname|pr[ée]nom|nombre) \] (?!\()
    | X{{4,}} (?!\w)
    )""",
    regex.X,
)
#: What every slot holds one of.
_MAY_SLOT = regex.compile(r"[{\[%@~$_<&]|XXXX|(?i:here)")
_ABOUT = regex.compile(r"\b(?:regex|regular expression|escape|escaping|template engine|format string|placeholder|syntax|literal|macro|variable|interpolat\w*|parse[rs]?|renders?|such as|for example|e\.g\.)\b", regex.I)


def mask(text: str) -> str:
    """text with code and quotations blanked out; a quotation of nothing but a slot stays."""
    if "`" in text or "<" in text or "~~~" in text:
        text = _FENCE.sub(" ¤ ", text)
    if "    " in text or "\t\t" in text or ">" in text or "&gt;" in text:
        text = _INDENT.sub(" ¤ ", text)
    return _QUOTE.sub(lambda m: m[0] if _SLOT.fullmatch(m[0].removeprefix("&quot;").removesuffix("&quot;").strip("\"“”„«» ")) else " ¤ ", text)


def segments(masked: str) -> list[str]:
    """The messages of a masked text: its lines and sentences in lower case, without markup and wrappers."""
    flat = _TAG.sub(" ", _BREAK.sub("\n", masked)) if "<" in masked else masked
    flat = html.unescape(flat) if "&" in flat else flat
    pieces, at = [], 0
    for m in _SENTENCE.finditer(flat):
        pieces.append(flat[at : m.start() + (m["end"] is not None or m["full"] is not None)])
        at = m.end()
    pieces.append(flat[at:])
    out = []
    for s in pieces:
        s = _WRAP.sub("", s.strip())
        if s.rstrip().rstrip(".!").lower().endswith(_TRAILERS):
            s = _TRAIL.sub("", s)
        s = " ".join(s.lower().split()).strip("…·*#=-–—|> ")
        if _WORD.search(s):
            out.append(s)
    return out


_DIGIT = regex.compile(r"[0-9]")


def words_of(segment: str) -> list[str]:
    """The words of a message, those with digits as slots of the template."""
    # A question mark is a word of its own: it says who speaks and must outlive generalising.
    words = segment.replace("?", " ? ").split()
    if segment.isascii() and not _DIGIT.search(segment):
        return words
    return ["<*>" if any(map(str.isdigit, w)) else w for w in words]


@functools.lru_cache(1 << 16)
def _stays(word: str) -> bool:
    """Whether no template generalises a word, wherever it stands."""
    own = _WORD.findall(word)
    return word in ("<*>", "?") or not (KEPT.isdisjoint(own) and TALK.isdisjoint(own))


def leaf_of(words: list[str]) -> list[str]:
    """The path of a message in the tree: its words, blank where a template of it may have a slot."""
    return words[:DEPTH] + [w if _stays(w) else "" for w in words[DEPTH:]]


def merged(a: list[str], b: list[str]) -> list[str]:
    """The template of two messages, or templates, of one leaf."""
    return [x if x == y else "<*>" for x, y in zip(a, b)]


def broad(template: str) -> bool:
    """Whether a template says of a page, a request or the like that something became of it."""
    return len(_WORD.findall(template)) <= 30 and not _TALK.search(template) and any(p.fullmatch(template) for p in _BROAD)


def verdict(template: str) -> int:
    """2: the message is residue wherever it stands; 1: it is where nothing else stands; 0: it is not."""
    words = _WORD.findall(template)
    core = template.strip(" .,:;!()[]{}<>\"'")
    if not words:
        return 0
    if not _TALK.search(template):
        if _SCRIPT.search(template) and _DEMAND.search(template) and len(words) <= 30:
            return 2
        if "cookies" in words and _DEMAND.search(template) and len(words) <= 20:
            return 2
        if len(words) <= 40 and any(p.fullmatch(template) or p.fullmatch(core) for p in _STRONG):
            return 2
    latin = sum(w in LOREM for w in words)
    sure = sum(w in LOREM and w not in SHARED for w in words)
    if latin >= 4 and sure >= 3 and latin >= 0.6 * len(words):
        return 2
    # A slot of a filler is a word like any other.
    if len(words) <= 40 and _FILLER.fullmatch(core.replace("<*>", "0")):
        return 2 if len(words) > 1 else 1
    if len(words) <= 40 and any(p.fullmatch(template) for p in _WEAK) and not _TALK.search(template):
        return 1
    if broad(template):
        return 1
    plain = [w for w in words if w != "*"]
    if len(plain) >= 2 and len(set(plain)) == 1:
        return 1
    if len(plain) >= 3 and len(set(plain)) <= 3 and len(plain) >= 2 * len(set(plain)):
        return 1
    return 0


def has_slot(masked: str) -> bool:
    """Whether a slot stands unresolved in a record that does not write about slots there."""
    for m in _SLOT.finditer(masked) if _MAY_SLOT.search(masked) else ():
        a = max(masked.rfind(c, 0, m.start()) for c in ".\n?!") + 1
        ends = [e for e in (masked.find(c, m.end()) for c in ".\n?!") if e >= 0]
        if not _ABOUT.search(masked[a : min(ends, default=len(masked))]):
            return True
    return False


def judge(template: str, n: int, alone: int) -> int:
    """The verdict of a template that occurs n times, alone of them as a whole text; see verdict.

    Where the wording alone does not decide the tree does: a message about a page or a request, or a
    short one made mostly of cues, in nobody's name, that recurs and often is all that a record holds.
    """
    known = verdict(template)
    if known == 2 or n < SUPPORT or alone < ALONE * n or _TALK.search(template):
        return known
    if known == 1:
        return 2 if broad(template) else 1
    words = [w for w in _WORD.findall(template) if w != "*"]
    cues = sum(w in CUES for w in words)
    return 2 if cues >= 2 and len(words) <= LONGEST and cues >= DENSE * len(words) else 0


_CANDIDATES = "why string, parts int, record binary, message int, leaf binary, template string, n long, alone long"


def _candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ...): what one reading of the corpus finds, of three kinds.

    Records with a slot (why); messages that may get a verdict (record, parts: messages of the
    record, message: its number, leaf); and templates of the leaves (leaf, template, n, alone),
    merged within each batch. Only rows of the last kind hold text.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out, leaves = [], {}
            for k, t in zip(d["key"], d["text"]):
                masked = mask(t)
                if has_slot(masked):
                    out.append((k, "slot", None, None, None, None, None, None, None))
                parts = segments(masked)
                record = None
                for number, s in enumerate(parts):
                    if not may_classify(s):
                        continue
                    words = words_of(s)
                    path = " ".join(leaf_of(words))
                    known = leaves.get(path)
                    if known is None:
                        known = leaves[path] = [hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).digest(), words, 0, 0]
                    elif known[1] != words:
                        known[1] = merged(known[1], words)
                    known[2] += 1
                    known[3] += len(parts) == 1
                    record = record or hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    out.append((k, None, len(parts), record, number, known[0], None, None, None))
            out += [(None, None, None, None, None, leaf, " ".join(words), n, alone) for leaf, words, n, alone in leaves.values()]
            yield pd.DataFrame(out, columns=["key", *(x.split()[0] for x in _CANDIDATES.split(", "))])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null"), "key")
    return rows.mapInPandas(run, f"key {kind}, {_CANDIDATES}")


def _templates(found: DataFrame) -> DataFrame:
    """(leaf, template, n, alone, verdict): the leaves of all batches merged and classified."""
    places = found.where("template is not null").select("leaf", "n", "alone", F.posexplode(F.split("template", " ")).alias("p", "w"))
    # A place where messages differ is a slot; the smallest and the greatest word tell, so a leaf of any number of messages is aggregated before it is shuffled.
    one = places.groupBy("leaf", "p").agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("n").alias("n"), F.sum("alone").alias("alone"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("<*>")
    whole = one.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("p", word.alias("w")))).alias("ws"), F.max("n").alias("n"), F.max("alone").alias("alone"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["verdict"] = [judge(t, n, a) for t, n, a in zip(d["template"], d["n"], d["alone"])]
            yield d

    return whole.select("leaf", F.array_join("ws.w", " ").alias("template"), "n", "alone").mapInPandas(run, "leaf binary, template string, n long, alone long, verdict int")


def message_templates(df: DataFrame, text: str) -> DataFrame:
    """(template, n, alone, verdict): every mined template with the number of its messages, how many of them are a whole text, and its verdict."""
    return _templates(cut(_candidates(df.select(F.lit(1).alias("key"), F.col(text).alias("text")), "key", "text"))).drop("leaf")


def residue(df: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """(key, why): records that are residue or hold a piece of it, why being 'message' or 'slot', the latter if both.

    Null, empty and blank texts and rows without a key are no cases; a record delivered twice is
    reported once, and its texts are judged apart; only the named columns are read; an empty table
    gives no rows. Whole texts are read once. What is shuffled are the templates of messages that
    may get a verdict, and the records and leaves of those that have one; the most frequent `block`
    templates with a verdict are broadcast, the others joined by a shuffle. A record's weak messages
    are decided after all its marks are gathered.
    """
    found = cut(_candidates(df, key, text))
    judged = cut(_templates(found).where("verdict > 0").select("leaf", "n", "verdict"))
    messages = found.where("record is not null").select("key", "record", "parts", "message", "leaf")
    if judged.count() <= block:
        marks = messages.join(F.broadcast(judged.drop("n")), "leaf")
    else:
        top = F.broadcast(judged.orderBy(F.desc("n"), "leaf").limit(block).drop("n"))
        marks = messages.join(top, "leaf").unionByName(messages.join(top, "leaf", "left_anti").join(judged.drop("n"), "leaf"))
    texts = marks.groupBy("key", "record", "parts").agg(F.max("verdict").alias("most"), F.countDistinct("message").alias("n"))
    cases = texts.where("most = 2 or n = parts").select("key", F.lit("message").alias("why"))
    cases = cases.unionByName(found.where("why is not null").select("key", "why"))
    return cases.groupBy(F.col("key").alias(key)).agg(F.max("why").alias("why"))
