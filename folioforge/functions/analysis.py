"""Document analysis as column expressions: type, code, flags, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that decide a document's type.
CODE_EXTENSIONS = (".py", ".js", ".java", ".cpp", ".c", ".go", ".rs")
BOOK_WORDS = ("chapter ", "preface", "table of contents")
ARTICLE_WORDS = ("abstract", "introduction", "methodology", "references")
CODE_MARKS = ("def ", "class ", "import ", "function", "() {", "};", "const ", "var ", "let ", "#include", "public static", "private void", "if (", "for (", "while (")
SUPPORTED = (".txt", ".md", ".py", ".js", ".json", ".yaml", ".yml", ".log", ".pdf")
LOADABLE = (".pdf", ".txt", ".md", ".markdown")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def has_code(text: Column) -> Column:
    return any_of(text, CODE_MARKS)


def document_type(path: Column, text: Column) -> Column:
    ext, first, head = extension(path), F.substring(text, 1, 1000), F.lower(F.substring(text, 1, 2000))
    return (
        F.when(ext.isin(*CODE_EXTENSIONS), "code")
        .when((ext == ".log") | any_of(first, ("ERROR", "INFO")), "log")
        .when(any_of(head, BOOK_WORDS), "book")
        .when(any_of(head, ARTICLE_WORDS), "article")
        .when((ext == ".md") | F.contains(F.upper(file_name(path)), F.lit("README")), "documentation")
        .otherwise("other")
    )


def document_id(path: Column) -> Column:
    stem = F.regexp_replace(file_name(path), r"\.[^./]+$", "")
    return F.concat(F.lit("doc_"), stem, F.lit("_"), F.substring(F.md5(path), 1, 8))
