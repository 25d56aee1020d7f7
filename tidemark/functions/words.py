"""Word lists and tables of the text rules. Results depend on each entry and on their order."""

CONTRACTIONS = {
    "what's": "what is", "don't": "do not", "i'm": "i am", "it's": "it is", "there's": "there is", "that's": "that is",
    "how's": "how is", "where's": "where is", "who's": "who is", "when's": "when is", "why's": "why is", "can't": "cannot",
    "won't": "will not", "shouldn't": "should not", "wouldn't": "would not", "couldn't": "could not", "doesn't": "does not",
    "didn't": "did not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "mustn't": "must not", "mightn't": "might not",
    "needn't": "need not", "let's": "let us", "i've": "i have", "you've": "you have", "we've": "we have",
    "they've": "they have", "i'll": "i will", "you'll": "you will", "he'll": "he will", "she'll": "she will",
    "it'll": "it will", "we'll": "we will", "they'll": "they will", "i'd": "i would", "you'd": "you would",
    "he'd": "he would", "she'd": "she would", "we'd": "we would", "they'd": "they would",
}

TYPOS = {
    "disignation": "designation", "desgination": "designation", "desigation": "designation", "coustomers": "customers",
    "custommers": "customers", "cusotmers": "customers", "emplyees": "employees", "employes": "employees",
    "employess": "employees", "produts": "products", "producst": "products", "ordres": "orders", "ordes": "orders",
    "salay": "salary", "sallary": "salary", "deparment": "department", "departmnet": "department",
    "departement": "department", "recods": "records", "recrods": "records", "recorts": "records", "shwo": "show",
    "sohw": "show", "form": "from", "fom": "from", "eamil": "email", "emial": "email", "emai": "email",
    "adress": "address", "adres": "address", "ciy": "city", "ciyt": "city", "cites": "cities", "categroy": "category",
    "catgeory": "category", "catagory": "category", "statsu": "status", "satus": "status", "detailes": "details",
    "infomation": "information", "manger": "manager", "managr": "manager",
}

LEXICON = (
    "show", "list", "display", "customers", "employees", "orders", "products", "departments", "sales", "designation",
    "salary", "department", "email", "city", "status", "category", "records", "data", "all", "from", "where", "count",
    "average", "total", "maximum", "minimum", "above", "below",
)

#: Phrase in a question and the SQL keyword it hints at.
KEYWORDS = {
    "show": "SELECT", "list": "SELECT", "display": "SELECT", "get": "SELECT", "find": "SELECT", "fetch": "SELECT",
    "give": "SELECT", "tell": "SELECT", "what": "SELECT", "which": "SELECT", "who": "SELECT", "all": "SELECT",
    "count total": "COUNT", "total rows": "COUNT", "total records": "COUNT", "count": "COUNT", "how many": "COUNT",
    "total": "SUM", "sum": "SUM", "average": "AVG", "avg": "AVG", "mean": "AVG", "maximum": "MAX", "max": "MAX",
    "highest": "ORDER BY DESC", "largest": "MAX", "biggest": "MAX", "minimum": "MIN", "min": "MIN",
    "lowest": "ORDER BY ASC", "smallest": "MIN", "least": "MIN", "where": "WHERE", "filter": "WHERE", "with": "WHERE",
    "having": "HAVING", "greater than": ">", "more than": ">", "above": ">", "higher than": ">", "exceeds": ">",
    "over": ">", "larger than": ">", "bigger than": ">", "less than": "<", "below": "<", "under": "<",
    "lower than": "<", "fewer than": "<", "smaller than": "<", "beneath": "<", "not more than": "<=", "at most": "<=",
    "no more than": "<=", "no greater than": "<=", "at least": ">=", "no less than": ">=", "minimum of": ">=",
    "equal to": "=", "equals": "=", "not equal": "!=", "not": "!=", "that has": "WHERE", "that have": "WHERE",
    "whose": "WHERE", "order by": "ORDER BY", "sort by": "ORDER BY", "sorted by": "ORDER BY", "ranked by": "ORDER BY",
    "order": "ORDER BY", "sort": "ORDER BY", "sorted": "ORDER BY", "rank": "ORDER BY", "ranked": "ORDER BY",
    "ascending": "ASC", "descending": "DESC", "top": "ORDER BY DESC LIMIT", "bottom": "ORDER BY ASC LIMIT",
    "first": "LIMIT", "last": "ORDER BY DESC LIMIT", "group by": "GROUP BY", "grouped by": "GROUP BY", "per": "GROUP BY",
    "each": "GROUP BY", "every": "GROUP BY", "join": "JOIN", "with their": "JOIN", "along with": "JOIN",
    "including": "JOIN", "combined with": "JOIN", "limit": "LIMIT", "only": "LIMIT", "and": "AND", "or": "OR",
}

FEATURES = {
    "aggregate": ("count", "sum", "avg", "average", "max", "minimum", "min", "maximum"),
    "comparison": ("greater", "less", "above", "below", "more than", "less than", "at least", "at most", "between", "equal"),
    "order": ("top", "bottom", "first", "last", "sort", "order by", "ranked", "highest", "lowest", "most expensive", "cheapest"),
    "join": ("and", "with", "their", "along", "including", "combined", "join"),
    "group": ("group", "per", "each", "every", "grouped"),
    "limit": ("limit", "only"),
}

#: Intent by words of a question, the first that has one of its words.
QUESTION_INTENTS = (
    ("SELECT_JOIN", (" and ", "with their", "along with", "including", "combined", "join")),
    ("SELECT_GROUP", ("group", "per ", "each ")),
    ("SELECT_AGGREGATE", ("count", "sum", "avg", "average", "max", "min")),
    ("SELECT_ORDER", ("top ", "bottom ", "first ", "last ", "sort", "order", "highest", "lowest")),
    ("SELECT_WHERE", ("where", "filter", "with ", "above", "below", "greater", "less")),
    ("SELECT_LIMIT", ("limit", "only")),
)
INTENTS = ("SELECT", "SELECT_WHERE", "SELECT_AGGREGATE", "SELECT_ORDER", "SELECT_JOIN", "SELECT_GROUP", "SELECT_LIMIT", "COMPLEX")
SQL_AGGREGATES = ("COUNT", "SUM", "AVG", "MAX", "MIN")
SQL_WORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "ON", "AND", "OR", "NOT", "COUNT", "SUM", "AVG", "MAX", "MIN", "HAVING", "ASC",
    "DESC", "LIMIT", "OFFSET", "DISTINCT", "ALL", "AS", "IN", "LIKE", "IS", "NULL", "TRUE", "FALSE", "CASE", "WHEN",
    "THEN", "ELSE", "END", "BETWEEN",
)

FOLLOW_UP = {
    "starts": ("now", "also", "additionally", "furthermore", "and also", "what about", "how about"),
    "reference": ("them", "they", "those", "these", "it", "that", "this", "the same", "same", "such", "the ones", "there", "their", "ones", "which"),
    "additive": ("also", "too", "as well", "additionally", "in addition", "furthermore", "moreover"),
    "refining": ("but", "except", "however", "instead", "rather", "only", "just"),
    "count": ("how many", "count", "total number", "number of", "how much"),
    "sort": ("sort", "order", "rank", "arrange", "top", "bottom", "highest", "lowest", "ascending", "descending", "asc", "desc"),
    "filter": ("cost", "price", "above", "below", "greater", "less", "equal", "at least", "at most", ">", "<", "="),
}

#: Words that noise may misspell, and how.
MISSPELLINGS = {
    "show": ("shw", "sho", "shwo", "sohw", "shoe", "showw"), "list": ("lst", "lsit", "lisr", "lits", "lis"),
    "find": ("fnd", "fined", "fidn", "fin"), "all": ("al", "aall", "alll"),
    "total": ("totl", "toatl", "totla", "toal"), "count": ("cont", "coutn", "ccount", "countt"),
    "average": ("avrage", "averge", "avarage", "averag", "avergae"), "order": ("ordr", "oder", "ordeer"),
    "orders": ("ordrs", "oders", "orderes"), "with": ("wth", "wiht", "witth"), "from": ("frm", "fom", "froom"),
    "than": ("thn", "tahn", "thna"), "more": ("mroe", "mor", "moer"), "less": ("les", "lees", "lss"),
    "above": ("abve", "abov", "aboev", "abov"), "below": ("belw", "belo", "bellow", "beolw"),
    "number": ("numbr", "numer", "numbre"), "department": ("departmnt", "deparment", "depatment", "departement"),
    "customer": ("custmer", "customar", "customr", "cutomer"), "records": ("recods", "recrds", "recordss", "recors"),
}
NEAR_KEYS = {
    "a": "sq", "b": "vn", "c": "xv", "d": "sf", "e": "wr", "f": "dg", "g": "fh", "h": "gj", "i": "uo", "j": "hk",
    "k": "jl", "l": "ko", "m": "nb", "n": "bm", "o": "ip", "p": "ol", "q": "wa", "r": "et", "s": "ad", "t": "ry",
    "u": "yi", "v": "cb", "w": "qe", "x": "zc", "y": "tu", "z": "xa",
}
DROPPABLE = ("the", "a", "an", "is", "are", "all", "from", "in", "of")
FILLERS = ("plz", "pls", "plese", "can u", "i want", "gimme")
#: Grammar rewrites: what is replaced by what; then what stands before and after the question in lower case, and what is taken out of it.
REWRITES = (
    ("Show all ", "show me the "), ("List all ", "list me all "), ("How many ", "how much "), ("What is the ", "whats "),
    ("What is the ", "wat is "), ("Find all ", "find me "), ("Display ", "show me "), (" above ", " more then "),
    (" below ", " less then "), (" greater than ", " more then "), (" less than ", " less then "),
    (" more than ", " more then "), (" with ", " having "), (" with ", " wid "), ("earning", "who earn"),
)
AFFIXES = (
    ("pls ", "", ()), ("i want ", "", ()), ("", " plz", ()), ("give me ", "", ("show ", "list ")),
    ("tell me ", "", ("show ", "list ")), ("", "", ()),
)

ERRORS = (("no such table", "table"), ("no such column", "column"), ("syntax error", "syntax"), ("no results", "empty"))

#: English words that say nothing of a subject, in the usual order of such lists. Fixed values.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
