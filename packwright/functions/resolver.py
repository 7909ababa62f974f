"""Candidate names for dotted surface chains, as joins with two fixed dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families of the global context, their manager, the placeholder of an item, and the item's manager.
FAMILIES = (
    ("Документы", "ДокументыМенеджер", "<Имя документа>", "ДокументМенеджер"),
    ("Справочники", "СправочникиМенеджер", "<Имя справочника>", "СправочникМенеджер"),
    ("Перечисления", "ПеречисленияМенеджер", "<Имя перечисления>", "ПеречислениеМенеджер"),
    ("Константы", "КонстантыМенеджер", "<Имя константы>", "КонстантаМенеджер"),
    ("РегистрыНакопления", "РегистрыНакопленияМенеджер", "<Имя регистра накопления>", "РегистрНакопленияМенеджер"),
    ("РегистрыСведений", "РегистрыСведенийМенеджер", "<Имя регистра сведений>", "РегистрСведенийМенеджер"),
    ("РегистрыБухгалтерии", "РегистрыБухгалтерииМенеджер", "<Имя регистра бухгалтерии>", "РегистрБухгалтерииМенеджер"),
    ("РегистрыРасчета", "РегистрыРасчетаМенеджер", "<Имя регистра расчета>", "РегистрРасчетаМенеджер"),
    ("ПланыСчетов", "ПланыСчетовМенеджер", "<Имя плана счетов>", "ПланСчетовМенеджер"),
    ("ПланыВидовХарактеристик", "ПланыВидовХарактеристикМенеджер", "<Имя плана видов характеристик>", "ПланВидовХарактеристикМенеджер"),
    ("ПланыВидовРасчета", "ПланыВидовРасчетаМенеджер", "<Имя плана видов расчета>", "ПланВидовРасчетаМенеджер"),
    ("ПланыОбмена", "ПланыОбменаМенеджер", "<Имя плана обмена>", "ПланОбменаМенеджер"),
    ("БизнесПроцессы", "БизнесПроцессыМенеджер", "<Имя бизнес-процесса>", "БизнесПроцессМенеджер"),
    ("Задачи", "ЗадачиМенеджер", "<Имя задачи>", "ЗадачаМенеджер"),
    ("Отчеты", "ОтчетыМенеджер", "<Имя отчета>", "ОтчетМенеджер"),
    ("Отчёты", "ОтчетыМенеджер", "<Имя отчета>", "ОтчетМенеджер"),
    ("Обработки", "ОбработкиМенеджер", "<Имя обработки>", "ОбработкаМенеджер"),
    ("ХранилищаНастроек", "ХранилищаНастроекМенеджер", "<Имя хранилища>", "ХранилищеНастроекМенеджер"),
    ("ЖурналыДокументов", "ЖурналыДокументовМенеджер", "<Имя журнала документов>", "ЖурналДокументовМенеджер"),
    ("КритерииОтбора", "КритерииОтбораМенеджер", "<Имя критерия>", "КритерийОтбораМенеджер"),
    ("Последовательности", "ПоследовательностиМенеджер", "<Имя последовательности>", "ПоследовательностьМенеджер"),
    ("WSСсылки", "WSСсылкиМенеджер", "<Имя WS-Ссылки>", "WSСсылкаМенеджер"),
    ("ВнешниеИсточникиДанных", "ВнешниеИсточникиДанныхМенеджер", "<Имя внешнего источника>", "ВнешнийИсточникДанныхМенеджер"),
    ("СервисыИнтеграции", "СервисыИнтеграцииМенеджер", "<Имя сервиса интеграции>", "СервисИнтеграцииМенеджер"),
)
# Metadata collections and the object that each of their items is.
COLLECTIONS = (
    ("Документы", "Документ"), ("Справочники", "Справочник"), ("Перечисления", "Перечисление"), ("Константы", "Константа"), ("РегистрыСведений", "РегистрСведений"),
    ("РегистрыНакопления", "РегистрНакопления"), ("РегистрыБухгалтерии", "РегистрБухгалтерии"), ("РегистрыРасчета", "РегистрРасчета"), ("ПланыСчетов", "ПланСчетов"),
    ("ПланыВидовХарактеристик", "ПланВидовХарактеристик"), ("ПланыВидовРасчета", "ПланВидовРасчета"), ("ПланыОбмена", "ПланОбмена"), ("БизнесПроцессы", "БизнесПроцесс"),
    ("Задачи", "Задача"), ("Отчеты", "Отчет"), ("Отчёты", "Отчет"), ("Обработки", "Обработка"), ("ХранилищаНастроек", "ХранилищеНастроек"), ("КритерииОтбора", "КритерийОтбора"),
    ("ЖурналыДокументов", "ЖурналДокументов"), ("Последовательности", "Последовательность"),
)


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "family string, manager string, placeholder string, item_manager string")


def collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COLLECTIONS, "family string, kind string")


def _chain(query: Column, *prefixes: str) -> Column:
    bare = F.regexp_replace(F.trim(query), f"^(?:{'|'.join(prefixes)})", "")
    return F.filter(F.transform(F.split(bare, "[.]"), lambda x: F.trim(x)), lambda x: x != "")


def _candidates(*pairs: tuple[Column, str]) -> Column:
    """array<struct<name, lookup>> in rank order, nulls and repeats dropped."""
    made = [F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(lookup).alias("lookup"))) for name, lookup in pairs]
    return F.array_distinct(F.array_compact(F.array(*made)))


def surface_candidates(queries: DataFrame, query: str) -> DataFrame:
    """queries with ``candidates`` of chains like family.item.member; empty where the root is no family."""
    parts = _chain(F.col(query), "Глобальный контекст[.]", "ГлобальныйКонтекст[.]", "Global context[.]")
    rows = queries.withColumn("_p", parts).withColumn("_root", F.get("_p", F.lit(0)))
    known = F.broadcast(families(queries.sparkSession))  # 24 fixed rows
    joined = rows.join(known, F.col("_root") == F.col("family"), "left")
    second, n = F.get("_p", F.lit(1)), F.size("_p")
    item = F.concat_ws(".", "item_manager", "placeholder")
    tail = F.array_join(F.slice("_p", F.lit(3), F.greatest(n - 2, F.lit(0))), ".")
    found = _candidates(
        (F.when(n >= 3, F.concat_ws(".", item, tail)), "member"),
        (F.concat(F.lit("Глобальный контекст."), "family"), "member"),
        (F.col("manager"), "object"),
        (F.when(n >= 2, F.concat_ws(".", "manager", second)), "member"),
        (F.when(n >= 2, F.concat_ws(".", "manager", "placeholder")), "member"),
        (F.when(n >= 2, item), "object"),
    )
    none = F.array().cast("array<struct<name:string,lookup:string>>")
    out = joined.withColumn("candidates", F.when(F.col("family").isNotNull(), found).otherwise(none))
    return out.select(*queries.columns, "candidates")


def metadata_candidates(queries: DataFrame, query: str) -> DataFrame:
    """queries with ``candidates`` of chains below the metadata root; empty for other chains."""
    q = F.trim(F.col(query))
    root = r"(?:Глобальный контекст[.]|ГлобальныйКонтекст[.]|Global context[.])?(?:Метаданные|Metadata)"
    rows = queries.withColumn("_is", q.rlike(f"^{root}(?:[.]|$)")).withColumn("_p", _chain(q, f"{root}(?:[.]|$)"))
    rows = rows.withColumn("_root", F.get("_p", F.lit(0)))
    joined = rows.join(F.broadcast(collections(queries.sparkSession)), F.col("_root") == F.col("family"), "left")  # 21 fixed rows
    second, catalog = F.get("_p", F.lit(1)), F.col("_root") == "СвойстваОбъектов"
    found = _candidates(
        (F.when(catalog & second.isNotNull(), F.concat(F.lit("ПеречислимыеСвойстваОбъектовМетаданных."), second)), "member"),
        (F.when(catalog & second.isNotNull(), second), "object"),
        (F.when(catalog, F.lit("ОбъектМетаданныхКонфигурация.СвойстваОбъектов")), "member"),
        (F.when(catalog, F.lit("ПеречислимыеСвойстваОбъектовМетаданных")), "object"),
        (F.when(F.col("kind").isNotNull(), F.concat(F.lit("ОбъектМетаданныхКонфигурация."), "_root")), "member"),
        (F.when(F.col("kind").isNotNull(), F.concat(F.lit("ОбъектМетаданных: "), "kind")), "object"),
        (F.when(F.col("kind").isNotNull() & second.isNotNull(), F.concat_ws(".", "_root", second)), "metadata_graph"),
        (F.lit("Глобальный контекст.Метаданные"), "member"),
        (F.lit("ОбъектМетаданныхКонфигурация"), "object"),
    )
    none = F.array().cast("array<struct<name:string,lookup:string>>")
    return joined.withColumn("candidates", F.when(F.col("_is"), found).otherwise(none)).select(*queries.columns, "candidates")


def resolved(queries: DataFrame, query: str) -> DataFrame:
    """Metadata candidates where there are any, else surface candidates."""
    meta = metadata_candidates(queries, query).withColumnRenamed("candidates", "_meta")
    both = surface_candidates(meta, query)
    return both.withColumn("candidates", F.when(F.size("_meta") > 0, F.col("_meta")).otherwise(F.col("candidates"))).drop("_meta")
