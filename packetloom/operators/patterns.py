"""Payload pattern detectors: one operator over a table of pattern families.

The payload is decoded once per packet and every family is tested in the same pass, inside one
projection; only hits leave it. Suppression is a separate step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions import net, text
from packetloom.functions.timecols import micros, to_us
from packetloom.operators.alerts import as_alerts, source_address, target_address, union_all
from packetloom.operators.chains import cooldown, greedy_chain
from packetloom.operators.durable import checkpointed

# ---------------------------------------------------------------------------------------------
# The patterns of every family, as written by the detectors they come from.
# ---------------------------------------------------------------------------------------------

SQLI_PATTERNS = {
    1000040: (
        "SQL Injection - Classic pattern detected",
        [
            r"(\bor\b|\|\|)\s*['\"]?\s*\d+\s*[=<>]+\s*\d+",
            r"(\band\b|&&)\s*['\"]?\s*\d+\s*[=<>]+\s*\d+",
            r"['\"]?\s*or\s*['\"]?\s*['\"]?\s*=\s*['\"]?",
            r"admin['\"]?\s*(--|#|\/\*)",
        ],
    ),
    1000041: (
        "SQL Injection - UNION SELECT attack",
        [r"\bunion\b.*\bselect\b", r"\/\*!?\d*union\*\/", r"\bunion\b.*\ball\b.*\bselect\b"],
    ),
    1000042: (
        "SQL Injection - Time-based blind attack",
        [r"\b(sleep|benchmark|waitfor|pg_sleep)\s*\(", r";\s*waitfor\s+delay\s+['\"]", r"benchmark\s*\(\s*\d+"],
    ),
    1000043: (
        "SQL Injection - Boolean-based blind attack",
        [
            r"\bif\s*\(\s*\d+\s*[=<>]",
            r"\bcase\b.*\bwhen\b.*\bthen\b",
            r"(ascii|ord|substring|substr)\s*\(.*\)\s*[=<>]",
        ],
    ),
    1000044: (
        "SQL Injection - Error-based attack",
        [r"(extractvalue|updatexml|exp)\s*\(", r"convert\s*\(\s*int", r"cast\s*\(.*\bas\b"],
    ),
    1000045: (
        "SQL Injection - Stacked queries attack",
        [r";\s*(drop|insert|update|delete|create|alter)\b", r";\s*exec\s*\(", r";\s*declare\s+@"],
    ),
    1000046: (
        "NoSQL Injection - MongoDB/NoSQL attack",
        [r"\$ne", r"\$gt", r"\$lt", r"\$regex", r"\$where", r"\[\$"],
    ),
    1000049: (
        "SQL Injection - Tautology-based attack ('a'='a' pattern)",
        [
            r"['\"]?\s*or\s+['\"]?[a-z]+['\"]?\s*=\s*['\"]?[a-z]+",
            r"['\"]?\s*or\s+\d+\s*between\s+\d+\s*and\s*\d+",
        ],
    ),
}
SQL_COMMENTS = [r"\/\*!?\d*\w+\*\/", r"--[^\r\n]*", r"#[^\r\n]*", r"\/\*.*?\*\/"]
SQL_KEYWORDS = (
    r"\b(select|union|insert|update|delete|drop|create|alter|exec|execute|"
    r"declare|cast|convert|substring|ascii|char|concat|information_schema|"
    r"sys\.tables|sys\.columns|xp_cmdshell|sp_executesql)\b"
)
COMMENT_BYPASS = (1000047, "SQL Injection - Comment-based bypass")
ENCODING_BYPASS = (1000048, "SQL Injection - Encoding-based bypass (multiple encoding)")

XSS_PATTERNS = {
    1000070: (
        "XSS: Script tag injection detected",
        [
            r"<script[^>]*>",
            r"</script>",
            r"<script[^>]*src\s*=",
            r"<script>\s*alert\s*\(",
            r"<script>\s*eval\s*\(",
        ],
    ),
    1000071: (
        "XSS: Event handler injection detected",
        [
            r"\bon\w+\s*=\s*[\"']?\s*(alert|eval|confirm|prompt|javascript:)",
            r"onerror\s*=",
            r"onload\s*=",
            r"onclick\s*=",
            r"onmouseover\s*=",
            r"onfocus\s*=",
            r"onanimationend\s*=",
        ],
    ),
    1000072: (
        "XSS: JavaScript protocol injection detected",
        [
            r"javascript:\s*(alert|eval|confirm|prompt|window\.)",
            r"data:text/html[,;]",
            r"data:text/html;base64,",
            r"vbscript:",
        ],
    ),
    1000073: (
        "XSS: DOM-based XSS pattern detected",
        [
            r"(document\.|window\.|location\.|eval\()",
            r"\.innerHTML\s*=",
            r"\.outerHTML\s*=",
            r"document\.write\s*\(",
            r"\.location\s*=\s*[\"']javascript:",
        ],
    ),
    1000074: (
        "XSS: Encoded/obfuscated XSS detected",
        [
            r"&#x?\d+;.*&#x?\d+;.*&#x?\d+;",
            r"\\u00[3-7][0-9a-f]",
            r"\\x[0-9a-f]{2}",
            r"%[0-9a-f]{2}%[0-9a-f]{2}%[0-9a-f]{2}",
            r"&#60;script",
            r"&lt;script",
        ],
    ),
    1000075: (
        "XSS: SVG-based XSS detected",
        [
            r"<svg[^>]*onload\s*=",
            r"<svg[^>]*>.*<script",
            r"<animatetransform[^>]*onbegin\s*=",
            r"<set[^>]*onbegin\s*=",
        ],
    ),
    1000076: (
        "XSS: iframe/embed injection detected",
        [r"<iframe[^>]*src\s*=", r"<embed[^>]*src\s*=", r"<object[^>]*data\s*=", r"<iframe[^>]*srcdoc\s*="],
    ),
    1000077: (
        "XSS: Attribute breaking XSS detected",
        [
            r"[\"']\s*>\s*<script",
            r"[\"']\s*onerror\s*=",
            r">\s*<img[^>]*src\s*=\s*x\s+onerror",
            r"[\"']\s*autofocus\s+onfocus\s*=",
        ],
    ),
    1000078: (
        "XSS: Template injection detected",
        [r"\{\{.*constructor.*\}\}", r"\{\{.*\[.*\].*\}\}", r"\$\{.*\}", r"<%.*%>"],
    ),
    1000079: (
        "XSS: Polyglot XSS payload detected",
        [
            r"javascript:.*alert.*\(.*\)",
            r"<.*onerror.*=.*alert.*\(",
            r"'\s*\+\s*alert\s*\(",
            r"\"\s*\+\s*alert\s*\(",
        ],
    ),
}

RCE_PATTERNS = {
    1000050: (
        "RCE - Malicious file upload detected",
        [
            r"\.(php[3-7]?|phtml|jsp|jspx|aspx?|asa|cer|cdx|shtm|shtml|"
            r"exe|bat|cmd|sh|bash|zsh|ps1|vbs|dll|so|"
            r"py|rb|pl|cgi|war|ear|jar)\b",
            r"\.(php|jsp|asp|aspx|exe|sh)\.(?:jpg|jpeg|png|gif|txt|pdf)",
            r"%00|\\x00|\x00",
        ],
    ),
    1000051: (
        "RCE - Web shell upload detected",
        [
            r"(?s)<\?php.*(?:eval|system|exec|shell_exec|passthru|base64_decode)\s*\(",
            r"(?:c99|r57|b374k|wso|shell|backdoor|webshell)",
            r"FilesMan|WSO\s*Shell|C99Shell|R57Shell",
            r"(?s)<%.*(?:eval|execute)\s*\(.*request",
        ],
    ),
    1000052: (
        "RCE - PHP code execution attempt",
        [
            r"\beval\s*\(",
            r"\b(?:system|exec|shell_exec|passthru|popen|proc_open)\s*\(",
            r"\b(?:assert|create_function|call_user_func(?:_array)?)\s*\(",
            r"`[^`]*(?:ls|cat|whoami|id|pwd|wget|curl)",
            r"\$_(?:GET|POST|REQUEST|COOKIE)\[.*\]\s*\(",
        ],
    ),
    1000053: (
        "RCE - OS command injection detected",
        [
            r"[;&|]\s*(?:ls|cat|whoami|id|pwd|uname|wget|curl|nc|netcat|bash|sh)\b",
            r"(?:\||;|&&|\$\(|\`)\s*(?:cat|ls|rm|chmod|chown|kill|ps|ifconfig|netstat)",
            r"/etc/passwd|/etc/shadow|/bin/bash|/bin/sh",
            r"cmd\.exe|powershell\.exe|wscript\.exe|cscript\.exe",
        ],
    ),
    1000054: (
        "RCE - Python code execution attempt",
        [
            r"\b(?:__import__|eval|exec|compile|execfile|input)\s*\(",
            r"os\.(?:system|popen|spawn|exec)",
            r"subprocess\.(?:call|Popen|run|check_output)",
            r"pickle\.loads?\(",
        ],
    ),
    1000055: (
        "RCE - Deserialization attack detected",
        [r"rO0AB|aced0005", r'O:\d+:"', r"__reduce__|__setstate__", r"\.readObject\(|ObjectInputStream"],
    ),
    1000056: (
        "RCE - Template injection (SSTI) detected",
        [
            r"\{\{.*(?:config|self|request|lipsum|cycler|joiner|namespace)\b",
            r"\{\{.*\.__(?:class|base|mro|subclasses|globals|init|import)__",
            r"\$\{.*(?:Class|Runtime|ProcessBuilder)",
            r"\{\{.*\|safe\}\}|\{\%.*\%\}",
        ],
    ),
    1000057: (
        "RCE - Expression Language injection",
        [
            r"\$\{(?:param|header|cookie|request)\.",
            r"#(?:request|response|session|context)\[",
            r"T\(java\.lang\.Runtime\)",
        ],
    ),
    1000058: (
        "RCE - XXE injection detected",
        [r"<!ENTITY\s+\w+\s+SYSTEM", r"<!ENTITY.*file://", r"<!DOCTYPE.*\[<!ENTITY"],
    ),
    1000059: (
        "RCE - LDAP injection detected",
        [r"\(\s*\|\s*\(", r"\*\s*\)\s*\(", r"\(\s*&\s*\(.*\)\s*\(.*objectClass=\*"],
    ),
    1000060: (
        "RCE - File inclusion (LFI/RFI) detected",
        [
            r"(?:file|include|require|require_once|include_once)\s*\(\s*[\"']?(?:http|ftp|php|data|expect|zip):",
            r"(?:file|page|inc|module)=(?:http|ftp|php|data):",
            r"php://(?:filter|input|stdin)",
            r"data:text/plain;base64,",
        ],
    ),
    1000061: (
        "RCE - Path traversal detected",
        [r"\.\.[\\/]\.\.[\\/]", r"(?:\.\.%2[fF]){2,}", r"(?:\.\.%5[cC]){2,}", r"%2e%2e[\\/]|\.\.%5c"],
    ),
    1000062: (
        "RCE - ShellShock attack detected",
        [r"\(\s*\)\s*\{\s*:;\s*\};", r"\(\)\s*\{\s*ignored;\s*\}\s*;"],
    ),
    1000063: (
        "RCE - Log4Shell (CVE-2021-44228) detected",
        [r"\$\{jndi:(?:ldap|rmi|dns)://", r"\$\{jndi:\$\{lower:"],
    ),
    1000064: (
        "RCE - Polyglot file upload detected",
        [r"(?s)GIF89a.*<\?php", r"(?s)\xFF\xD8\xFF.*<\?php", r"(?s)%PDF.*<\?php"],
    ),
    1000065: (
        "RCE - ASP/ASPX code execution attempt",
        [
            r"(?s)<%.*(?:eval|execute|CreateObject|WScript\.Shell|Scripting\.FileSystemObject)",
            r"Server\.(?:CreateObject|Execute|ScriptTimeout)",
        ],
    ),
    1000066: (
        "RCE - JSP code execution attempt",
        [r"(?s)<%.*(?:Runtime\.getRuntime|ProcessBuilder|exec)", r"<jsp:(?:include|forward|plugin)"],
    ),
    1000067: (
        "RCE - Node.js code execution attempt",
        [
            r"require\s*\(\s*[\"']child_process[\"']\s*\)",
            r"(?:spawn|exec|execSync|fork)\s*\(",
            r"vm\.(?:runInNewContext|runInThisContext)",
        ],
    ),
    1000068: ("RCE - Perl code execution attempt", [r"\beval\s*\{|system\s*\(|exec\s*\(|`", r"open\s*\(.*\|"]),
    1000069: (
        "RCE - Ruby code execution attempt",
        [r"\beval\s*\(|system\s*\(|exec\s*\(|`", r"IO\.popen|Open3\.|Kernel\."],
    ),
}

# Patterns matched with case, and families that look at the text before or besides URL decoding.
CASE_SENSITIVE = {r"\{\{.*\[.*\].*\}\}", r"<%.*%>", r"%00|\\x00|\x00"}
RAW_FAMILIES = {1000074}
BYTE_FAMILIES = {1000064}

SQLI_PORTS = [80, 8080, 8000, 443, 8443]
WEB_PORTS = [80, 8080, 8000, 443, 8443, 3000, 5000, 8888, 9090]

# Suppression in seconds. XSS needs more than its value to pass, the others exactly it.
SQLI_COOLDOWN = 30
XSS_COOLDOWN = 60
RCE_COOLDOWN = 60
RCE_COOLDOWNS = {1000051: 120, 1000055: 90, 1000062: 90, 1000063: 90}

# Words a text must hold, case folded, for a pattern to have a chance: one of each group. A plain
# substring test is far cheaper than the pattern and spares nearly all texts the regular expression.
NEEDS = {
    SQLI_PATTERNS[1000040][1][0]: [["or", "||"], ["=", "<", ">"]],
    SQLI_PATTERNS[1000040][1][1]: [["and", "&&"], ["=", "<", ">"]],
    SQLI_PATTERNS[1000040][1][2]: [["or"], ["="]],
    SQLI_PATTERNS[1000040][1][3]: [["admin"], ["--", "#", "/*"]],
    SQLI_PATTERNS[1000041][1][0]: [["union"], ["select"]],
    SQLI_PATTERNS[1000041][1][1]: [["union*/"]],
    SQLI_PATTERNS[1000041][1][2]: [["union"], ["all"], ["select"]],
    SQLI_PATTERNS[1000042][1][0]: [["sleep", "benchmark", "waitfor"], ["("]],
    SQLI_PATTERNS[1000042][1][1]: [["waitfor"], ["delay"]],
    SQLI_PATTERNS[1000042][1][2]: [["benchmark"]],
    SQLI_PATTERNS[1000043][1][0]: [["if"], ["("], ["=", "<", ">"]],
    SQLI_PATTERNS[1000043][1][1]: [["case"], ["when"], ["then"]],
    SQLI_PATTERNS[1000043][1][2]: [["ascii", "ord", "substr"], ["("], [")"]],
    SQLI_PATTERNS[1000044][1][0]: [["extractvalue", "updatexml", "exp"], ["("]],
    SQLI_PATTERNS[1000044][1][1]: [["convert"], ["int"]],
    SQLI_PATTERNS[1000044][1][2]: [["cast"], ["("], ["as"]],
    SQLI_PATTERNS[1000045][1][0]: [[";"], ["drop", "insert", "update", "delete", "create", "alter"]],
    SQLI_PATTERNS[1000045][1][1]: [[";"], ["exec"]],
    SQLI_PATTERNS[1000045][1][2]: [["declare"], ["@"]],
    SQLI_PATTERNS[1000046][1][0]: [["$ne"]],
    SQLI_PATTERNS[1000046][1][1]: [["$gt"]],
    SQLI_PATTERNS[1000046][1][2]: [["$lt"]],
    SQLI_PATTERNS[1000046][1][3]: [["$regex"]],
    SQLI_PATTERNS[1000046][1][4]: [["$where"]],
    SQLI_PATTERNS[1000046][1][5]: [["[$"]],
    SQLI_PATTERNS[1000049][1][0]: [["or"], ["="]],
    SQLI_PATTERNS[1000049][1][1]: [["between"], ["and"], ["or"]],
    SQL_COMMENTS[0]: [["/*"], ["*/"]],
    SQL_COMMENTS[1]: [["--"]],
    SQL_COMMENTS[2]: [["#"]],
    SQL_COMMENTS[3]: [["/*"], ["*/"]],
    XSS_PATTERNS[1000070][1][0]: [["<script"], [">"]],
    XSS_PATTERNS[1000070][1][1]: [["</script>"]],
    XSS_PATTERNS[1000070][1][2]: [["<script"], ["src"]],
    XSS_PATTERNS[1000070][1][3]: [["<script>"], ["alert"]],
    XSS_PATTERNS[1000070][1][4]: [["<script>"], ["eval"]],
    XSS_PATTERNS[1000071][1][0]: [["on"], ["="], ["alert", "eval", "confirm", "prompt", "javascript:"]],
    XSS_PATTERNS[1000071][1][1]: [["onerror"]],
    XSS_PATTERNS[1000071][1][2]: [["onload"]],
    XSS_PATTERNS[1000071][1][3]: [["onclick"]],
    XSS_PATTERNS[1000071][1][4]: [["onmouseover"]],
    XSS_PATTERNS[1000071][1][5]: [["onfocus"]],
    XSS_PATTERNS[1000071][1][6]: [["onanimationend"]],
    XSS_PATTERNS[1000072][1][0]: [["javascript:"]],
    XSS_PATTERNS[1000072][1][1]: [["data:text/html"]],
    XSS_PATTERNS[1000072][1][2]: [["data:text/html;base64,"]],
    XSS_PATTERNS[1000072][1][3]: [["vbscript:"]],
    XSS_PATTERNS[1000073][1][0]: [["document.", "window.", "location.", "eval("]],
    XSS_PATTERNS[1000073][1][1]: [[".innerhtml"]],
    XSS_PATTERNS[1000073][1][2]: [[".outerhtml"]],
    XSS_PATTERNS[1000073][1][3]: [["document.write"]],
    XSS_PATTERNS[1000073][1][4]: [[".location"], ["javascript:"]],
    XSS_PATTERNS[1000074][1][0]: [["&#"]],
    XSS_PATTERNS[1000074][1][1]: [["\\u00"]],
    XSS_PATTERNS[1000074][1][2]: [["\\x"]],
    XSS_PATTERNS[1000074][1][3]: [["%"]],
    XSS_PATTERNS[1000074][1][4]: [["&#60;script"]],
    XSS_PATTERNS[1000074][1][5]: [["&lt;script"]],
    XSS_PATTERNS[1000075][1][0]: [["<svg"], ["onload"]],
    XSS_PATTERNS[1000075][1][1]: [["<svg"], ["<script"]],
    XSS_PATTERNS[1000075][1][2]: [["<animatetransform"]],
    XSS_PATTERNS[1000075][1][3]: [["<set"], ["onbegin"]],
    XSS_PATTERNS[1000076][1][0]: [["<iframe"], ["src"]],
    XSS_PATTERNS[1000076][1][1]: [["<embed"]],
    XSS_PATTERNS[1000076][1][2]: [["<object"]],
    XSS_PATTERNS[1000076][1][3]: [["<iframe"], ["srcdoc"]],
    XSS_PATTERNS[1000077][1][0]: [["<script"], [">"], ["'", '"']],
    XSS_PATTERNS[1000077][1][1]: [["onerror"]],
    XSS_PATTERNS[1000077][1][2]: [["<img"], ["onerror"]],
    XSS_PATTERNS[1000077][1][3]: [["autofocus"]],
    XSS_PATTERNS[1000078][1][0]: [["{{"], ["constructor"]],
    XSS_PATTERNS[1000078][1][1]: [["{{"]],
    XSS_PATTERNS[1000078][1][2]: [["${"]],
    XSS_PATTERNS[1000078][1][3]: [["<%"]],
    XSS_PATTERNS[1000079][1][0]: [["javascript:"], ["alert"]],
    XSS_PATTERNS[1000079][1][1]: [["onerror"], ["alert"]],
    XSS_PATTERNS[1000079][1][2]: [["alert"], ["+"], ["'"]],
    XSS_PATTERNS[1000079][1][3]: [["alert"], ["+"], ['"']],
    RCE_PATTERNS[1000050][1][0]: [
        [".php", ".phtml", ".jsp", ".asp", ".asa", ".cer", ".cdx", ".shtm", ".exe", ".bat", ".cmd", ".sh", ".bash",
         ".zsh", ".ps1", ".vbs", ".dll", ".so", ".py", ".rb", ".pl", ".cgi", ".war", ".ear", ".jar"]
    ],
    RCE_PATTERNS[1000050][1][1]: [[".php.", ".jsp.", ".asp.", ".aspx.", ".exe.", ".sh."]],
    RCE_PATTERNS[1000050][1][2]: [["%00", "\\x00", "\x00"]],
    RCE_PATTERNS[1000051][1][0]: [["<?php"]],
    RCE_PATTERNS[1000051][1][1]: [["c99", "r57", "b374k", "wso", "shell", "backdoor"]],
    RCE_PATTERNS[1000051][1][2]: [["filesman", "wso", "c99shell", "r57shell"]],
    RCE_PATTERNS[1000051][1][3]: [["<%"], ["request"]],
    RCE_PATTERNS[1000052][1][0]: [["eval"], ["("]],
    RCE_PATTERNS[1000052][1][1]: [["system", "exec", "passthru", "popen", "proc_open"], ["("]],
    RCE_PATTERNS[1000052][1][2]: [["assert", "create_function", "call_user_func"], ["("]],
    RCE_PATTERNS[1000052][1][3]: [["`"]],
    RCE_PATTERNS[1000052][1][4]: [["$_"]],
    RCE_PATTERNS[1000053][1][0]: [[";", "&", "|"]],
    RCE_PATTERNS[1000053][1][1]: [["|", ";", "&&", "$(", "`"]],
    RCE_PATTERNS[1000053][1][2]: [["/etc/passwd", "/etc/shadow", "/bin/bash", "/bin/sh"]],
    RCE_PATTERNS[1000053][1][3]: [["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe"]],
    RCE_PATTERNS[1000054][1][0]: [["__import__", "eval", "exec", "compile", "input"], ["("]],
    RCE_PATTERNS[1000054][1][1]: [["os."]],
    RCE_PATTERNS[1000054][1][2]: [["subprocess."]],
    RCE_PATTERNS[1000054][1][3]: [["pickle.load"]],
    RCE_PATTERNS[1000055][1][0]: [["ro0ab", "aced0005"]],
    RCE_PATTERNS[1000055][1][1]: [["o:"]],
    RCE_PATTERNS[1000055][1][2]: [["__reduce__", "__setstate__"]],
    RCE_PATTERNS[1000055][1][3]: [[".readobject(", "objectinputstream"]],
    RCE_PATTERNS[1000056][1][0]: [["{{"]],
    RCE_PATTERNS[1000056][1][1]: [["{{"], [".__"]],
    RCE_PATTERNS[1000056][1][2]: [["${"]],
    RCE_PATTERNS[1000056][1][3]: [["|safe}}", "{%"]],
    RCE_PATTERNS[1000057][1][0]: [["${"]],
    RCE_PATTERNS[1000057][1][1]: [["#request", "#response", "#session", "#context"]],
    RCE_PATTERNS[1000057][1][2]: [["t(java.lang.runtime)"]],
    RCE_PATTERNS[1000058][1][0]: [["<!entity"]],
    RCE_PATTERNS[1000058][1][1]: [["<!entity"]],
    RCE_PATTERNS[1000058][1][2]: [["<!doctype"], ["<!entity"]],
    RCE_PATTERNS[1000059][1][0]: [["("], ["|"]],
    RCE_PATTERNS[1000059][1][1]: [["*"], [")"], ["("]],
    RCE_PATTERNS[1000059][1][2]: [["objectclass=*"]],
    RCE_PATTERNS[1000060][1][0]: [["file", "include", "require"], ["("], [":"]],
    RCE_PATTERNS[1000060][1][1]: [["=http:", "=ftp:", "=php:", "=data:"]],
    RCE_PATTERNS[1000060][1][2]: [["php://"]],
    RCE_PATTERNS[1000060][1][3]: [["data:text/plain;base64,"]],
    RCE_PATTERNS[1000061][1][0]: [["../", "..\\"]],
    RCE_PATTERNS[1000061][1][1]: [["..%2f"]],
    RCE_PATTERNS[1000061][1][2]: [["..%5c"]],
    RCE_PATTERNS[1000061][1][3]: [["%2e%2e", "..%5c"]],
    RCE_PATTERNS[1000062][1][0]: [["{"], ["}"], [":;"]],
    RCE_PATTERNS[1000062][1][1]: [["ignored;"]],
    RCE_PATTERNS[1000063][1][0]: [["${jndi:"]],
    RCE_PATTERNS[1000063][1][1]: [["${jndi:"]],
    RCE_PATTERNS[1000064][1][0]: [["<?php"]],
    RCE_PATTERNS[1000064][1][1]: [["<?php"]],
    RCE_PATTERNS[1000064][1][2]: [["<?php"]],
    RCE_PATTERNS[1000065][1][0]: [["<%"]],
    RCE_PATTERNS[1000065][1][1]: [["server."]],
    RCE_PATTERNS[1000066][1][0]: [["<%"]],
    RCE_PATTERNS[1000066][1][1]: [["<jsp:"]],
    RCE_PATTERNS[1000067][1][0]: [["require"], ["child_process"]],
    RCE_PATTERNS[1000067][1][1]: [["spawn", "exec", "fork"], ["("]],
    RCE_PATTERNS[1000067][1][2]: [["vm."], ["run"]],
    RCE_PATTERNS[1000068][1][0]: [["eval", "system", "exec", "`"]],
    RCE_PATTERNS[1000068][1][1]: [["open"], ["("], ["|"]],
    RCE_PATTERNS[1000069][1][0]: [["eval", "system", "exec", "`"]],
    RCE_PATTERNS[1000069][1][1]: [["io.popen", "open3.", "kernel."]],
}


def java_pattern(pattern: str, *, ignore_case: bool = True, unicode: bool = True) -> str:
    """Java spelling of a pattern: dot stops at line feed only, classes and case folding are Unicode."""
    dotall = pattern.startswith("(?s)")
    flags = "d" + ("i" if ignore_case else "") + ("uU" if unicode else "") + ("s" if dotall else "")
    return f"(?{flags})" + pattern.removeprefix("(?s)")


def _quoted(value: str) -> str:
    """SQL string literal; dollar signs are spelled out because the parser substitutes ${...}."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024").replace("\x00", "\\u0000")
    return f"'{escaped}'"


def fold(subject: Column) -> Column:
    """Lower case, with every letter a case-blind match takes for an ASCII letter made that letter."""
    out = F.lower(F.replace(subject, F.lit("İ"), F.lit("i")))
    for letter, plain in (("ı", "i"), ("ſ", "s")):
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


@dataclass(frozen=True)
class Subject:
    """SQL names of a text, of its folded form, and of the flags for the words tested up front."""

    text: str
    folded: str
    flags: dict[str, str]

    def holds(self, word: str) -> str:
        return self.flags.get(word) or f"contains({self.folded}, {_quoted(word)})"

    def may_match(self, pattern: str) -> str:
        """Necessary condition for the pattern; groups of words with ready flags come first."""
        groups = sorted(NEEDS.get(pattern, []), key=lambda g: not all(w in self.flags for w in g))
        return " AND ".join("(" + " OR ".join(self.holds(w) for w in group) + ")" for group in groups)

    def finds(self, pattern: str) -> str:
        exact = f"{self.text} RLIKE {_quoted(java_pattern(pattern, ignore_case=pattern not in CASE_SENSITIVE))}"
        needed = self.may_match(pattern)
        return f"({needed} AND {exact})" if needed else f"({exact})"

    def finds_any(self, patterns: list[str]) -> str:
        return "(" + " OR ".join(self.finds(p) for p in patterns) + ")"


def shared_words(patterns: list[str]) -> list[str]:
    """Words that several patterns need: tested once per text and kept as flags."""
    seen: dict[str, int] = {}
    for pattern in patterns:
        for word in {w for group in NEEDS.get(pattern, []) for w in group}:
            seen[word] = seen.get(word, 0) + 1
    return sorted(w for w, n in seen.items() if n > 1)


def _byte_finds(raw: Subject, patterns: list[str]) -> str:
    """Search among the characters that are single bytes; only ASCII letters fold."""
    narrow = f"regexp_replace({raw.text}, {_quoted('[^\\x00-\\xff]')}, '')"
    tests = [f"{narrow} RLIKE {_quoted(java_pattern(p, unicode=False))}" for p in patterns]
    # Dropping wide characters can join the words, so only single characters may be sought before it.
    return f"(contains({raw.text}, '<') AND contains({raw.text}, '?') AND ({' OR '.join(tests)}))"


def comment_bypass(decoded: Subject) -> str:
    """A SQL keyword together with at least two kinds of comment."""
    kinds = " + ".join(f"CAST({decoded.finds(p)} AS INT)" for p in SQL_COMMENTS)
    return f"({kinds} >= 2 AND {decoded.finds(SQL_KEYWORDS)})"


def encoding_bypass(raw: Subject, decoded: Subject) -> str:
    """Decoding reveals a classic injection, or more SQL keywords and at least two."""
    classic = SQLI_PATTERNS[1000040][1]
    revealed = " OR ".join(f"({decoded.finds(p)} AND NOT {raw.finds(p)})" for p in classic)
    keywords = _quoted(java_pattern(SQL_KEYWORDS))
    before, after = (f"regexp_count({s.text}, {keywords})" for s in (raw, decoded))
    return f"({raw.text} <> {decoded.text} AND ({revealed} OR ({after} > {before} AND {after} >= 2)))"


TABLES = {"SQLiDetector": SQLI_PATTERNS, "XSSDetector": XSS_PATTERNS, "RCEDetector": RCE_PATTERNS}
PAYLOAD_DETECTORS = list(TABLES)


def families(detector: str, raw: Subject, decoded: Subject) -> Iterator[tuple[int, str, str]]:
    """(sid, message, SQL test) of every family of a detector."""
    for sid, (info, patterns) in TABLES[detector].items():
        if sid in BYTE_FAMILIES:
            yield sid, info, _byte_finds(raw, patterns)
        else:
            yield sid, info, (raw if sid in RAW_FAMILIES else decoded).finds_any(patterns)
    if detector == "SQLiDetector":
        yield *COMMENT_BYPASS, comment_bypass(decoded)
        yield *ENCODING_BYPASS, encoding_bypass(raw, decoded)


def on_ports(ports: list[int]) -> Column:
    return F.col("src_port").isin(ports) | F.col("dst_port").isin(ports)


def applies(detector: str, raw: Column) -> Column:
    """What a packet must be for the detector to look at it."""
    if detector == "SQLiDetector":
        return on_ports(SQLI_PORTS) & text.is_http_request(raw)
    if detector == "XSSDetector":
        return on_ports(WEB_PORTS) & net.is_ip() & (raw.startswith("GET ") | raw.startswith("POST "))
    return on_ports(WEB_PORTS) & (raw.startswith("POST") | F.contains(raw, F.lit("Content-Type")))


def pattern_hits(packets: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """One row per (packet, family found), before suppression."""
    chosen = detectors or PAYLOAD_DETECTORS
    # Ports are tested on the scan, before any payload is decoded.
    carried = packets.where(net.is_tcp() & (F.length("payload") > 0) & on_ports(WEB_PORTS)).select(
        "packet_id",
        "ts",
        "src_port",
        "dst_port",
        "ip_proto",
        source_address().alias("src"),
        target_address().alias("dst"),
        text.utf8_text(F.col("payload")).alias("raw"),
    )
    raw = F.col("raw")
    gates = {f"gate_{i}": F.coalesce(applies(d, raw), F.lit(False)) for i, d in enumerate(chosen)}
    looked_at = F.lit(False)
    for name in gates:
        looked_at = looked_at | F.col(name)
    encoded = F.contains(raw, F.lit("%")) | F.contains(raw, F.lit("+"))
    decoded = F.when(encoded & looked_at, text.deep_url_decode(raw)).otherwise(raw)
    ready = (
        carried.withColumns(gates)
        .withColumn("decoded", decoded)
        .withColumn("raw_folded", F.when(looked_at, fold(raw)))
        .withColumn(
            "decoded_folded", F.when(F.col("decoded") == raw, F.col("raw_folded")).otherwise(fold(F.col("decoded")))
        )
    )
    words = shared_words([p for d in chosen for _, ps in TABLES[d].values() for p in ps] + SQL_COMMENTS)
    flags = {word: f"w{i}" for i, word in enumerate(words)}
    as_sent, as_read = Subject("raw", "raw_folded", {}), Subject("decoded", "decoded_folded", flags)
    ready = ready.selectExpr("*", *[f"contains(decoded_folded, {_quoted(w)}) AS {name}" for w, name in flags.items()])
    found = [
        f"CASE WHEN gate_{i} AND {test} THEN named_struct('detector', '{detector}', 'sid', {sid}, 'info', {_quoted(info)}) END"
        for i, detector in enumerate(chosen)
        for sid, info, test in families(detector, as_sent, as_read)
    ]
    # An outer explode: an inner one would add a filter that evaluates every pattern twice.
    hits = ready.selectExpr("packet_id", "ts", "src", "dst", f"explode_outer(array_compact(array({', '.join(found)}))) AS hit")
    return hits.where("hit is not null").select("packet_id", "ts", "src", "dst", "hit.detector", "hit.sid", "hit.info")


def _suppressed(hits: DataFrame, detector: str) -> DataFrame:
    keys = ["src", "sid"]
    if detector == "SQLiDetector":
        return cooldown(hits, keys, SQLI_COOLDOWN, strict=False)
    if detector == "XSSDetector":
        return cooldown(hits, keys, XSS_COOLDOWN, strict=True)
    # Stretching time by 360 / seconds gives every family the same gap, so one chain serves all.
    stretch = F.lit(360 // RCE_COOLDOWN)
    for sid, seconds in RCE_COOLDOWNS.items():
        stretch = F.when(F.col("sid") == sid, 360 // seconds).otherwise(stretch)
    placed = hits.withColumn("__pos", micros(hits, "ts") * stretch)
    return greedy_chain(placed, keys, to_us(360)).drop("__pos")


def _detect(packets: DataFrame, detector: str) -> DataFrame:
    kept = _suppressed(pattern_hits(packets, [detector]), detector)
    return as_alerts(kept, detector, F.col("sid"), F.col("info"), F.col("src"), F.col("dst"))


def detect_payloads(packets: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """The chosen payload detectors over one pass: payloads are decoded and searched once, hits are stored, then suppressed apart."""
    chosen = detectors or PAYLOAD_DETECTORS
    hits = checkpointed(pattern_hits(packets, chosen))
    parts = []
    for detector in chosen:
        kept = _suppressed(hits.where(F.col("detector") == detector), detector)
        parts.append(as_alerts(kept, detector, F.col("sid"), F.col("info"), F.col("src"), F.col("dst")))
    return union_all(parts)


def detect_sqli(packets: DataFrame) -> DataFrame:
    return _detect(packets, "SQLiDetector")


def detect_xss(packets: DataFrame) -> DataFrame:
    return _detect(packets, "XSSDetector")


def detect_rce(packets: DataFrame) -> DataFrame:
    return _detect(packets, "RCEDetector")
