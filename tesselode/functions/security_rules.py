"""The security rules as a table: weakness, language, name, pattern (RE2 syntax), confidence. What matches them is in operators/security.py."""

# Weaknesses with name, description and severity.
WEAKNESSES = [
    ("CWE-78", "OS Command Injection", "Improper neutralization of special elements used in an OS command.", "HIGH"),
    ("CWE-89", "SQL Injection", "Improper neutralization of special elements used in an SQL command.", "HIGH"),
    ("CWE-79", "Cross-site Scripting", "Improper neutralization of input during webpage generation.", "MEDIUM"),
    ("CWE-119", "Buffer Overflow", "Improper restriction of operations within the bounds of a memory buffer.", "HIGH"),
    ("CWE-125", "Out-of-bounds Read", "Reading from or writing to a buffer using uninitialized or freed resources.", "HIGH"),
    ("CWE-704", "Improper Type Conversion", "The software attempts to convert between incompatible types.", "MEDIUM"),
    ("CWE-787", "Out-of-bounds Write", "Writing out-of-bounds memory.", "HIGH"),
    ("CWE-416", "Use After Free", "Use of reused or expired memory.", "HIGH"),
    ("CWE-352", "CSRF", "Cross-Site Request Forgery.", "MEDIUM"),
    ("CWE-287", "Authentication Bypass", "Improper authentication.", "HIGH"),
    ("CWE-502", "Deserialization of Untrusted Data", "Deserialization of untrusted data.", "HIGH"),
    ("CWE-22", "Path Traversal", "Improper restriction of pathnames.", "MEDIUM"),
    ("CWE-732", "Incorrect Permission Assignment", "Weak permissions.", "MEDIUM"),
    ("CWE-190", "Integer Overflow", "Integer overflow or wraparound.", "MEDIUM"),
    ("CWE-20", "Improper Input Validation", "Improper input validation.", "MEDIUM"),
    ("CWE-400", "Uncontrolled Resource Consumption", "Uncontrolled resource consumption.", "MEDIUM"),
    ("CWE-306", "Missing Authentication for Critical Function", "Missing authentication.", "HIGH"),
    ("CWE-862", "Missing Authorization", "Missing authorization.", "MEDIUM"),
    ("CWE-1333", "Inefficient Regular Expression", "ReDoS.", "MEDIUM"),
    ("CWE-665", "Improper Initialization", "Improper initialization.", "MEDIUM"),
    ("CWE-798", "Use of Hardcoded Credentials", "Hardcoded credentials.", "HIGH"),
    ("CWE-259", "Use of Hardcoded Password", "Hardcoded password.", "MEDIUM"),
    ("CWE-918", "Server-Side Request Forgery", "SSRF.", "HIGH"),
    ("CWE-327", "Use of a Broken or Risky Cryptographic Algorithm", "Weak crypto.", "MEDIUM"),
    ("CWE-326", "Inadequate Encryption Strength", "Weak encryption.", "MEDIUM"),
    ("CWE-639", "Insecure Direct Object Reference", "IDOR.", "MEDIUM"),
    ("CWE-611", "Improper Restriction of XML External Entity Reference", "XXE.", "MEDIUM"),
    ("CWE-1021", "Improper Restriction of Rendered UI Layers or Frames", "Clickjacking.", "MEDIUM"),
    ("CWE-476", "NULL Pointer Dereference", "NULL pointer dereference.", "MEDIUM"),
    ("CWE-703", "Improper Check for Unusual or Exceptional Conditions", "Error handling.", "LOW"),
]

# The rules, in the order in which they are tried.
RULES = [
    ("CWE-78", "python", "subprocess with shell=True", r"""(?i)subprocess\.(call|run|Popen|check_output)\(.*shell\s*=\s*True""", 0.9),
    ("CWE-78", "c", "system() call", r"""(?i)\bsystem\s*\(""", 0.8),
    ("CWE-78", "c", "popen() call", r"""(?i)\bpopen\s*\(""", 0.8),
    ("CWE-78", "go", "exec.Command with shell", r"""(?i)exec\.Command\s*\(\s*["'](/bin/sh|/bin/bash|cmd)["']""", 0.7),
    ("CWE-78", "go", "os.system equivalent", r"""(?i)exec\.Command\s*\(\s*["']sh["']\s*,\s*["']-c""", 0.8),
    ("CWE-78", "javascript", "child_process exec with shell", r"""(?i)require\s*\(\s*["']child_process["']\s*\)\.exec\s*\(""", 0.7),
    ("CWE-89", "python", "SQL string formatting", r"""(?i)(execute|cursor\.(execute|executemany))\s*\(\s*(["'].*%[sdb].*["']|f["'].*SELECT|f["'].*INSERT|f["'].*UPDATE|f["'].*DELETE)""", 0.85),
    ("CWE-89", "go", "SQL string formatting", r"""(?i)\b(Exec|Query)(.*Context)?\s*\(\s*.*fmt\.Sprintf""", 0.85),
    ("CWE-89", "c", "sprintf in SQL", r"""(?i)sprintf.*SELECT|sprintf.*INSERT|sprintf.*UPDATE|sprintf.*DELETE""", 0.7),
    ("CWE-89", "java", "string concatenation in SQL", r"""(?i)(Statement|PreparedStatement)\s*\.\s*(execute|prepare)\s*\([^)]*\+""", 0.6),
    ("CWE-89", "javascript", "SQL string concatenation", r"""(?i)(query|execute)\s*\(\s*['"].*\+.*[+\s].*['"]""", 0.5),
    ("CWE-89", "php", "SQL injection in PHP", r"""(?i)(mysql_query|mysqli::query)\s*\(\s*['"].*\$_(GET|POST|REQUEST)""", 0.9),
    ("CWE-79", "python", "mark_safe on user input", r"""(?i)mark_safe\s*\(""", 0.7),
    ("CWE-79", "python", "render_to_string with request", r"""(?i)render_to_string\s*\([^)]*request""", 0.6),
    ("CWE-79", "javascript", "dangerouslySetInnerHTML", r"""(?i)dangerouslySetInnerHTML""", 0.4),
    ("CWE-79", "javascript", "innerHTML assignment", r"""(?i)\.innerHTML\s*=""", 0.5),
    ("CWE-79", "java", "unescaped output in JSP", r"""<%[^>]*<%=.*request\.getParameter""", 0.6),
    ("CWE-119", "c", "strcpy without length", r"""(?i)\bstrcpy\s*\(""", 0.85),
    ("CWE-119", "c", "strcat without length", r"""(?i)\bstrcat\s*\(""", 0.85),
    ("CWE-119", "c", "sprintf without snprintf", r"""(?i)\bsprintf\s*\(""", 0.75),
    ("CWE-119", "c", "gets() call", r"""(?i)\bgets\s*\(""", 0.95),
    ("CWE-119", "c", "scanf without width limit", r"""(?i)\bscanf\s*\(\s*["'][^"']*%[^"']*["']""", 0.7),
    ("CWE-125", "c", "array access without bounds check", r"""(?i)\barr\[[^\]]+\]""", 0.5),
    ("CWE-787", "c", "memcpy without length check", r"""(?i)\bmemcpy\s*\(""", 0.6),
    ("CWE-416", "c", "free followed by use", r"""(?i)\bfree\s*\(""", 0.3),
    ("CWE-22", "python", "path traversal from user input", r"""(?i)open\s*\(\s*.*request\.""", 0.8),
    ("CWE-22", "c", "path traversal fopen", r"""(?i)\bfopen\s*\(\s*.*getenv""", 0.6),
    ("CWE-22", "go", "path traversal with user input", r"""(?i)os\.Open\s*\(\s*.*request\.|os\.OpenFile\s*\(\s*.*user""", 0.5),
    ("CWE-22", "javascript", "path traversal in require", r"""(?i)require\s*\(\s*.*req\.params|require\s*\(\s*.*req\.query""", 0.4),
    ("CWE-22", "php", "path traversal include", r"""(?i)(include|require)\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)""", 0.7),
    ("CWE-502", "python", "pickle load", r"""(?i)\bpickle\.(loads|load)\s*\(""", 0.9),
    ("CWE-502", "python", "yaml load without safe", r"""(?i)\byaml\.load\s*\(""", 0.8),
    ("CWE-502", "python", "yaml unsafe load_all", r"""(?i)yaml\.load_all\s*\(""", 0.7),
    ("CWE-502", "java", "Java deserialization", r"""(?i)(ObjectInputStream|readObject)\s*\(""", 0.7),
    ("CWE-502", "javascript", "unsafe deserialization", r"""(?i)(eval\(|Function\(|deserialize)""", 0.6),
    ("CWE-190", "c", "integer overflow potential", r"""(?i)\bmalloc\s*\(\s*[^)]*[\+\*]""", 0.5),
    ("CWE-190", "rust", "unsafe arithmetic", r"""(?i)unchecked_(add|sub|mul|div|rem)""", 0.6),
    ("CWE-20", "python", "eval() call", r"""(?i)\beval\s*\(""", 0.9),
    ("CWE-20", "python", "exec() call", r"""(?i)\bexec\s*\(""", 0.8),
    ("CWE-20", "javascript", "eval() call", r"""(?i)\beval\s*\(""", 0.7),
    ("CWE-20", "php", "eval() call", r"""(?i)\beval\s*\(""", 0.8),
    ("CWE-1333", "all", "potentially evil regex", r"""\([^)]*[+*][^)]*\)[+*]""", 0.4),
    ("CWE-1333", "javascript", "evil regex in JavaScript", r"""(?i)(RegExp|\.match|\.replace|\.split)\s*\(\s*["'][^"']*[^\]"']*[+*].*[+*].*["']""", 0.5),
    ("CWE-306", "c", "main without argument validation", r"""(?i)\bint\s+main\s*\(\s*int\s+argc""", 0.2),
    ("CWE-352", "python", "missing CSRF token", r"""(?i)@app\.route\([^)]*\)\s*\n\s*def\s+\w+\([^)]*\)\s*:\s*\n\s*[^@]*\b(request\.(post|get|put|delete|patch))""", 0.5),
    ("CWE-352", "javascript", "fetch without credentials mode", r"""(?i)\bfetch\s*\(""", 0.3),
    ("CWE-862", "python", "no authentication decorator", r"""(?i)@app\.route\([^)]*methods\s*=\s*\["?POST"?\s*,\s*"GET"?\s*\]\)""", 0.4),
    ("CWE-862", "go", "HTTP handler without auth", r"""(?i)http\.HandleFunc\s*\(\s*["'][^"']*["']\s*,\s*func\s*\(""", 0.4),
    ("CWE-798", "all", "hardcoded password string", r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][^"'<>]{3,}["']""", 0.9),
    ("CWE-798", "all", "hardcoded API key", r"""(?i)(api_key|apikey|secret|access_token)\s*[:=]\s*["'][^"'<>]{8,}["']""", 0.8),
    ("CWE-798", "python", "django secret key hardcoded", r"""(?i)SECRET_KEY\s*=\s*["'].*["']""", 0.9),
    ("CWE-798", "go", "hardcoded credential", r"""(?i)("password"|"secret")\s*:\s*["'][^"'<>]{3,}["']""", 0.7),
    ("CWE-259", "all", "hardcoded username/password", r"""(?i)(username|user)\s*[:=]\s*["'](admin|root|test|guest)["']""", 0.6),
    ("CWE-918", "python", "requests to user-controlled URL", r"""(?i)requests\.(get|post|put|delete)\s*\(\s*.*request\.""", 0.7),
    ("CWE-918", "go", "HTTP request to user URL", r"""(?i)http\.Get\s*\(\s*.*request\.|http\.Post\s*\(\s*.*request\.""", 0.6),
    ("CWE-918", "javascript", "fetch to user-controlled URL", r"""(?i)fetch\s*\(\s*.*\$\{|fetch\s*\(\s*.*req\.""", 0.6),
    ("CWE-918", "java", "URL open from user input", r"""(?i)new\s+(URL|HttpURLConnection)\s*\(\s*.*(request|param)""", 0.6),
    ("CWE-327", "python", "MD5 hash usage", r"""(?i)\bmd5\s*\(""", 0.6),
    ("CWE-327", "python", "SHA1 hash usage", r"""(?i)\bsha1\s*\(""", 0.5),
    ("CWE-327", "python", "DES/RC4 cipher usage", r"""(?i)\b(des|rc4|arc4|ecb)\b""", 0.7),
    ("CWE-327", "java", "weak cipher usage", r"""(?i)(MessageDigest|Cipher)\s*\.\s*(getInstance)\s*\(\s*["'](md5|des|rc4|aes/ecb)""", 0.8),
    ("CWE-327", "go", "MD5/SHA1 hash usage", r"""(?i)md5\.Sum|sha1\.Sum|md5\.New|sha1\.New""", 0.5),
    ("CWE-327", "javascript", "crypto.createCipher", r"""(?i)createCipher\s*\(""", 0.6),
    ("CWE-326", "c", "insecure random", r"""(?i)\brand\s*\(""", 0.4),
    ("CWE-639", "python", "user ID without authorization", r"""(?i)User\.objects\.get\s*\(\s*id\s*=\s*request\.""", 0.6),
    ("CWE-639", "javascript", "direct DB query with user ID", r"""(?i)findById\s*\(\s*req\.params""", 0.5),
    ("CWE-400", "javascript", "large JSON parse", r"""(?i)JSON\.parse\s*\(\s*.*req\.(body|query)""", 0.4),
    ("CWE-476", "c", "NULL pointer dereference", r"""(?i)\*\s*\(?\w+\s*\)""", 0.3),
    ("CWE-119", "rust", "unsafe block", r"""(?i)\bunsafe\b\s*\{""", 0.4),
    ("CWE-326", "all", "insecure random number generator", r"""(?i)\brand\s*\(\s*\)\s*%\s*\d+""", 0.5),
    ("CWE-1004", "all", "insecure SSL/TLS", r"""(?i)(ssl_verifypeer|verify_ssl|sslversion)\s*=\s*(false|0|SSLv2|SSLv3)""", 0.8),
    ("CWE-611", "all", "XXE: XML external entity", r"""(?i)(XMLParser|SimpleXMLElement|DOMDocument)\s*.*(LOAD_DTD|loadXml).*entity""", 0.6),
    ("CWE-1021", "all", "insecure redirect", r"""(?i)(redirect|location)\s*[:=]\s*.*req(uest|\.params)""", 0.5),
]
