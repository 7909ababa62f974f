"""Small grammars of help texts: parameter lines, type names, limits of use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packwright.functions.text import normalized, once, squeezed, strip

# How a parameter says that it must or may be given, and the mark of its type.
GIVEN, TYPE_MARK, NO_TYPE = "обязательный|необязательный", "Тип:", "—"
# Endings of type names, and words of lines that limit use.
TYPE_ENDINGS = (
    "Менеджер", "Коллекция", "Перечисления", "Перечисление", "ПеречислимыеСвойства", "Соответствие", "Структура", "Массив", "ФиксированныйМассив", "ТаблицаЗначений",
    "ДеревоЗначений", "ОписаниеТипов", "Запрос", "Ответ", "Список", "Набор", "Ссылка", "Объект", "Команда", "Форма", "Результат", "Процессор", "Компоновщик", "Схема",
    "Хранилище", "Булево", "Число", "Строка", "Дата", "Время", "УникальныйИдентификатор", "Неопределено",
)
LIMIT_WORDS = (
    "только", "недоступ", "не поддерж", "не использ", "клиент", "сервер", "интерактив", "внешнее соединение", "мобильн", "веб-клиент", "тонкий клиент", "толстый клиент",
)
#: Length of the whole text where no line limits use, and of a link's target.
WHOLE, TARGET = 400, 120
_PARAM = "struct<name:string,type:string,description:string>"


def _param(name: Column, kind: Column, text: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), text.alias("description")).cast(_PARAM)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), strip), lambda x: x != "")


def _in_one_line(lines: Column) -> Column:
    """Parameters of a text in one piece: ``<name> (обязательный) ... Тип: X . description`` one after another."""
    head = rf"<[^>]+>\s*\((?:{GIVEN})\)"
    chunks = F.regexp_extract_all(F.array_join(lines, " "), F.lit(rf"(?iu){head}(?:(?!{head}).)*"), F.lit(0))

    kind = rf"{TYPE_MARK}\s*(.+?)(?:\s+\.\s+|\.$)"

    def one(c: Column) -> Column:
        found = c.rlike(kind)
        text = F.when(found, strip(F.regexp_replace(c, rf"^.*?{kind}", ""))).otherwise(c)
        return _param(strip(F.regexp_extract(c, "^(<[^>]+>)", 1)), F.when(found, strip(F.regexp_extract(c, kind, 1))).otherwise(NO_TYPE), text)

    return F.transform(chunks, lambda c: once(squeezed(c), one))


def _line_by_line(lines: Column) -> Column:
    """Parameters of lines: ``<name>`` with its type and description in the lines below, ``**name** (type) — text``, or a bare name.

    The state says what the line before has opened: 0 nothing, 1 a name, 2 a name with its type.
    """
    marked = r"^\*\*(.+?)\*\*\s+\((.+?)\)(?:\s+—\s+(.*))?$"
    none = F.array().cast(f"array<{_PARAM}>")

    def step(acc: Column, line: Column) -> Column:
        fresh = F.when(line.startswith("-"), strip(F.regexp_replace(line, "^[- ]+", ""))).otherwise(line)
        return once(fresh, lambda x: taken(acc, line, x))

    def taken(acc: Column, line: Column, fresh: Column) -> Column:
        at, held = acc["state"], acc["held"]
        kind = (at == 1) & line.startswith(TYPE_MARK)
        opens = fresh.startswith("<") & F.contains(fresh, F.lit(">"))
        part = lambda k: strip(F.regexp_extract(fresh, marked, k))
        plain = F.when(fresh.rlike(marked), _param(part(1), part(2), part(3))).otherwise(_param(fresh, F.lit(""), F.lit("")))
        typed = _param(held["name"], F.coalesce(F.nullif(strip(F.substring(line, len(TYPE_MARK) + 1, 1_000_000)), F.lit("")), F.lit(NO_TYPE)), F.lit(""))
        described = _param(held["name"], held["type"], line)
        done = F.when(at == 0, F.when(opens | (fresh == ""), none).otherwise(F.array(plain))).when(kind, none).otherwise(F.array(described))
        state = F.when((at == 0) & opens, 1).when(kind, 2).otherwise(0)
        now = F.when((at == 0) & opens, _param(fresh, F.lit(NO_TYPE), F.lit(""))).when(kind, typed).otherwise(held)
        return F.struct(F.concat(acc["out"], done).alias("out"), state.alias("state"), now.alias("held"))

    start = F.struct(none.alias("out"), F.lit(0).alias("state"), F.lit(None).cast(_PARAM).alias("held"))
    return F.aggregate(lines, start, step, lambda acc: F.when(acc["state"] > 0, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))


def parameters(body: Column) -> Column:
    """array<struct<name, type, description>> of a parameter section in any of its three forms.

    Texts without bold names are first read as one piece; if that gives none, line by line. Null and blank texts have none.
    """

    def read(lines: Column) -> Column:
        pieces = F.when(F.exists(lines, lambda x: F.contains(x, F.lit("**"))), F.array().cast(f"array<{_PARAM}>")).otherwise(_in_one_line(lines))
        return once(pieces, lambda found: F.when(F.size(found) > 0, found).otherwise(_line_by_line(lines)))

    return once(_lines(body), read)


def type_name(c: Column) -> Column:
    """A type's name without its mark, stops and commas around it, and blanks inside its brackets."""
    bare = F.regexp_replace(squeezed(c), f"(?iu)^{TYPE_MARK}", "")
    tight = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(bare), r"\.\s*<", ".<"), r"<\s*", "<"), r"\s*>", ">")
    return strip(F.regexp_replace(tight, r"^[ .,\n\t]+|[ .,\n\t]+$", ""))


def is_type_name(c: Column) -> Column:
    """Whether a text looks like a type's name: dots or brackets, two capitals, or a known ending."""
    capitals = F.length(F.regexp_replace(c, r"[^\p{Lu}\p{Lt}]", ""))
    return (c != "") & (c.startswith("ОбъектМетаданных:") | c.rlike("[.<>]") | (capitals >= 2) | c.rlike(f"(?:{'|'.join(TYPE_ENDINGS)})$"))


def value_types(text: Column) -> Column:
    """Type names of a text, apart by commas or semicolons, the first of those that differ in case only.

    After the mark of a type all count; else those that look like one.
    """
    t = squeezed(text)
    marked = F.lower(t).startswith(TYPE_MARK.lower())
    bare = F.when(marked, strip(F.substring(t, len(TYPE_MARK) + 1, 1_000_000))).otherwise(t)
    names = F.transform(F.split(bare, r"\s*[,;]\s*"), lambda p: type_name(F.get(F.split(p, r"\s+\.\s+", 2), F.lit(0))))
    kept = F.filter(names, lambda n: (n != "") & (marked | is_type_name(n)))
    folded = F.transform(kept, F.lower)
    return F.filter(kept, lambda n, i: F.array_position(folded, F.lower(n)) == i + 1)


def described_type(text: Column) -> Column:
    """What stands after the mark of a type in a description, up to a stop that stands alone or ends it; else empty."""
    return strip(F.regexp_extract(squeezed(text), rf"{TYPE_MARK}\s*(.+?)(?:\s+\.\s+|\.$)", 1))


def is_link_target(c: Column) -> Column:
    """Whether a type's name is short and plain enough to be linked to."""
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return is_type_name(c) & (F.length(c) <= TARGET) & ~F.contains(c, F.lit("\n")) & (blanks < 4)


def restrictions(*bodies: Column) -> Column:
    """Lines that limit use by their words; without any the whole text in one line, cut at WHOLE characters."""
    whole = normalized(F.concat_ws("\n", *[F.nullif(b, F.lit("")) for b in bodies]))
    lines = F.filter(_lines(whole), lambda x: F.lower(x).rlike("|".join(LIMIT_WORDS)))
    one = squeezed(whole)
    cut = F.when(F.length(one) <= WHOLE, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, WHOLE - 3)), F.lit("...")))
    return F.when(F.size(lines) > 0, normalized(F.array_join(lines, "\n"))).otherwise(cut)
