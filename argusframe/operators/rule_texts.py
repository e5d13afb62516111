"""Report texts of the code rules: title, description, recommendation."""

TEXTS: dict[str, tuple[str, str, str]] = {
    "sql-injection": ("SQL built from strings", "A query text is put together from strings or template holes, so a caller may change the statement.", "Bind values as parameters of a prepared statement."),
    "nosql-injection": ("Unchecked document query", "Request data reaches a document-store filter as it is; operators may be smuggled in.", "Check the shape of the input against a schema first."),
    "xss-dangerouslysetinnerhtml": ("Raw HTML in a React element", "Markup is set without escaping, which runs any script it holds.", "Render text, or sanitise the markup beforehand."),
    "eval-usage": ("Call of eval", "Text is run as code.", "Parse data with a parser and drop the call."),
    "cors-wildcard": ("Any origin allowed", "Cross-origin reads are open to every site.", "List the origins that may read."),
    "cors-credentials-wildcard": ("Cross-origin credentials allowed", "Cookies are sent across origins; with an open origin list any site acts as the user.", "Name exact origins wherever credentials are on."),
    "hardcoded-password": ("Password in the code", "A literal password is part of the program text.", "Read it from a secret store at start-up."),
    "no-password-hash": ("Password stored as typed", "A password goes from the request into storage unhashed.", "Store a slow salted hash only."),
    "weak-jwt-secret": ("Short token secret", "A web token is signed with a short literal.", "Sign with a long random secret kept outside the code."),
    "missing-security-headers": ("No header hardening", "The server is created and nothing sets protective response headers.", "Add header middleware right after creating the server."),
    "exposed-debug-route": ("Debug or admin route", "A route for operators is reachable in the public router.", "Require a login for it or leave it out of production."),
    "open-redirect": ("Redirect to a caller's address", "The redirect target comes from the request.", "Redirect to known places only."),
    "unvalidated-upload": ("Upload of any file type", "Files are accepted without a type check.", "Check type and size, and keep uploads away from served folders."),
    "insecure-cookie": ("Cookie without protection", "Cookies are set and none of the protective attributes is switched on.", "Set the http-only, secure and same-site attributes."),
    "command-injection": ("Command built from input", "Outside text becomes part of a command.", "Pass fixed arguments as a list and never outside text."),
    "ssl-verification-disabled": ("Certificate checks off", "Peers are not verified, so traffic can be intercepted.", "Keep verification on and add private roots to the trust store."),
    "sensitive-url-params": ("Secret in an address", "A secret travels in the query string and ends up in logs.", "Send it in a header or in the body."),
    "no-rate-limiting": ("No request limit", "A login or API route can be called without limit.", "Throttle the route per caller."),
    "python-os-system": ("Call of os.system", "A shell runs the given text.", "Run a program with a list of arguments instead."),
    "python-pickle": ("Unpickling", "Loading a pickle runs code chosen by its author.", "Exchange data as JSON or another plain format."),
    "env-not-gitignored": ("Environment file may be committed", "The ignore list does not cover the environment file, which usually holds secrets.", "Add `.env*` to the ignore list."),
    "path-traversal": ("File path from input", "Outside text decides which file is opened.", "Resolve the path and check that it stays in its folder."),
    "path-traversal-express": ("Served file from input", "Outside text decides which file is sent.", "Serve from a fixed root and check the path."),
    "ssrf-fetch": ("Fetch of a caller's address", "The server fetches an address chosen from outside and may reach inner services.", "Allow known hosts only and refuse private ranges."),
    "weak-crypto-md5": ("MD5 in use", "MD5 is broken.", "Use SHA-256, or a password hash for passwords."),
    "weak-crypto-sha1": ("SHA-1 in use", "SHA-1 collisions are practical.", "Use SHA-256 or newer."),
    "weak-crypto-des": ("Broken cipher in use", "DES, RC2 and RC4 can be broken.", "Use an authenticated AES or ChaCha20 mode."),
    "insecure-random": ("Predictable random numbers", "The general random generator can be predicted.", "Use the cryptographic generator for anything secret."),
    "prototype-pollution": ("Deep merge of input", "Merging outside objects may rewrite shared prototypes.", "Check keys against a schema before merging."),
    "prototype-pollution-bracket": ("Property name from input", "An assignment takes its key from outside.", "Accept known keys only."),
    "loose-equality": ("Loose comparison of input", "The comparison converts types first.", "Compare with the strict operator."),
    "xss-innerhtml": ("Markup set from script", "Setting inner markup runs scripts it holds.", "Set text content or sanitise the markup."),
    "xss-document-write": ("Call of document.write", "Written text becomes markup.", "Create elements instead."),
    "yaml-unsafe-load": ("Unsafe YAML loading", "The full loader builds arbitrary objects.", "Use the safe loader."),
    "js-yaml-unsafe": ("YAML with the full schema", "The chosen schema can build functions.", "Keep to the safe schema."),
    "sensitive-data-logged": ("Secret in a log", "A logging call mentions a secret value.", "Log who and what happened, never the secret."),
    "no-csrf-protection": ("No forged-request check", "State-changing routes carry no token check.", "Add tokens or check the origin."),
    "jwt-none-algorithm": ("Unsigned tokens accepted", "The algorithm list allows unsigned tokens.", "List signing algorithms only."),
    "unhandled-async": ("Asynchronous route without error handling", "A rejected promise in the route is not handled.", "Catch errors or wrap the handler."),
    "redos-risk": ("Pattern built from input", "Outside text becomes a regular expression and may run for ages.", "Escape the text or avoid patterns."),
    "unsafe-json-parse": ("JSON of a request parsed unchecked", "Parsed data is used without checking its shape.", "Check it against a schema."),
    "python-subprocess-shell": ("Subprocess through a shell", "A shell interprets the command text.", "Pass a list of arguments without a shell."),
    "python-format-injection": ("Format call on input", "Format fields can read attributes of the values.", "Format checked values only."),
    "hardcoded-localhost": ("Local address in the code", "A local address is written into the program.", "Read the address from configuration."),
    "missing-auth-middleware": ("Route without a login check", "A route over personal data has no visible login check.", "Put a login check in front of the route group."),
}

AI_TEXTS: dict[str, tuple[str, str, str]] = {
    "ai/hardcoded-api-key-in-source": ("API key in the code", "A variable is set to something that looks like an API key.", "Read the key from the environment."),
    "ai/cors-allow-all-origins": ("Every origin accepted", "Cross-origin settings accept every site.", "List trusted origins."),
    "ai/raw-sql-concatenation": ("Query text joined with values", "Values are joined into a query text.", "Bind values as parameters."),
    "ai/express-no-helmet": ("Server without header middleware", "The server sets no protective headers.", "Add header middleware."),
    "ai/password-without-hashing": ("Password taken as typed", "A password from the request is used unhashed.", "Hash it with a slow algorithm."),
    "ai/jwt-weak-secret": ("Literal token secret", "A web token is signed with a literal.", "Keep the signing secret outside the code."),
    "ai/unvalidated-redirect": ("Redirect without a check", "A redirect follows an address from the request.", "Check it against known addresses."),
    "ai/exposed-admin-route": ("Operator route in the open", "An admin or debug route has no visible login check.", "Put a login check in front of it."),
}
