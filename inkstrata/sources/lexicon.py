"""Constant tables: label lexicon, translation dictionaries, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical labels, in order of priority.
LABELS = (
    "Back", "Next", "Cancel", "Close", "Open", "Save", "Delete", "Edit", "View", "Help", "About", "Menu", "Settings", "Search", "Home", "Filter", "List", "Files", "File", "Path", "Size",
    "Load", "Clear", "Rename", "Episodes", "Subtitles", "SFV", "Extract All", "Profile", "Account", "Reports", "Analytics", "Dashboard", "Notifications", "Download", "Upload", "Support",
    "Support us", "Calculator", "Calendar", "Charts", "Sales", "Archives", "Types", "Parts", "Attributes", "MediaInfo", "Patches", "Tags", "Continue", "Finish", "Install", "Browse", "Apply",
    "Retry", "Skip", "Accept", "Decline", "Update", "Previous", "OK", "Yes", "No",
)

# Translations of labels, of whole commands and of their operands (Russian).
LABEL_TRANSLATIONS = {
    "Back": "Назад", "Next": "Далее", "Cancel": "Отмена", "OK": "ОК", "Yes": "Да", "No": "Нет", "Continue": "Продолжить", "Finish": "Завершить", "Install": "Установить", "Browse": "Обзор",
    "Apply": "Применить", "Retry": "Повторить", "Skip": "Пропустить", "Accept": "Принять", "Decline": "Отклонить", "Update": "Обновить", "Previous": "Назад", "Sales": "Продажи",
    "Archives": "Архивы", "Attributes": "Атрибуты", "Types": "Типы", "Parts": "Части", "Charts": "Графики", "Calculator": "Калькулятор", "Calendar": "Календарь", "MediaInfo": "МедиаИнфо",
    "Patches": "Патчи", "Tags": "Теги", "Filter": "Фильтр", "List": "Список", "Files": "Файлы", "File": "Файл", "Path": "Путь", "Size": "Размер", "Load": "Загрузить", "Clear": "Очистить",
    "Rename": "Переименование", "Episodes": "Эпизоды", "Subtitles": "Субтитры", "SFV": "SFV", "Extract All": "Извлечь все", "Support": "Поддержка", "Support us": "Поддержите нас",
    "Settings": "Настройки", "Search": "Поиск", "Home": "Главная", "Profile": "Профиль", "Account": "Аккаунт", "Reports": "Отчеты", "Analytics": "Аналитика", "Dashboard": "Панель",
    "Notifications": "Уведомления", "Help": "Помощь", "About": "О программе", "Menu": "Меню", "Open": "Открыть", "Close": "Закрыть", "Save": "Сохранить", "Delete": "Удалить",
    "Edit": "Изменить", "View": "Вид", "Download": "Скачать", "Upload": "Загрузить",
}
COMMAND_TRANSLATIONS = {"Keyboard shortcuts": "Горячие клавиши", "Switch Monitor": "Переключить монитор", "Reset to Defaults": "Сбросить до значений по умолчанию"}
VERB_TRANSLATIONS = {"Toggle ": "Переключить ", "Enable ": "Включить ", "Disable ": "Отключить ", "Switch ": "Переключить ", "Reset to ": "Сбросить до "}
OPERAND_TRANSLATIONS = {
    "Monitor": "монитор", "Keyboard shortcuts": "горячие клавиши", "VR Mode": "режим VR", "VR Passthrough": "режим сквозного обзора VR", "Hand Passthrough": "сквозной обзор рук",
    "Desk Passthrough": "сквозной обзор стола", "Performance Overlay": "оверлей производительности", "Foveated Streaming": "фовеативный стриминг", "Defaults": "значений по умолчанию",
}

# Languages to translate from (the empty code: detect) and to.
SOURCE_LANGUAGES = (("", "Определить язык"), ("en", "English"), ("de", "Deutsch"), ("ja", "Japanese"), ("zh-Hans", "Chinese Simplified"), ("ru", "Русский"))
TARGET_LANGUAGES = (("ru", "Русский"), ("en", "English"), ("de", "Deutsch"), ("ja", "Japanese"), ("zh-Hans", "Chinese Simplified"))


def compact(label: str) -> str:
    return label.replace(" ", "").lower()


def labels(spark: SparkSession) -> DataFrame:
    """ord, label, compact."""
    return spark.createDataFrame([(i, x, compact(x)) for i, x in enumerate(LABELS)], "ord int, label string, compact string")


def languages(spark: SparkSession) -> DataFrame:
    """side, ord, code, name."""
    rows = [(side, i, c, n) for side, of in (("source", SOURCE_LANGUAGES), ("target", TARGET_LANGUAGES)) for i, (c, n) in enumerate(of)]
    return spark.createDataFrame(rows, "side string, ord int, code string, name string")


def swapped(source: str, target: str) -> tuple[str, str]:
    """Source and target exchanged, where both are chosen and each exists on the other side; else as they were."""
    targets, sources = {c.lower(): c for c, _ in TARGET_LANGUAGES}, {c.lower(): c for c, _ in SOURCE_LANGUAGES if c}
    if source.strip() and target.strip() and source.lower() in targets and target.lower() in sources:
        return sources[target.lower()], targets[source.lower()]
    return source, target


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list for the second engine."""
    one = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
