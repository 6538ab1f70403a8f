"""Documents with every oddity that the operators have to bear."""

LONG = "word another third " * 4000
ODD = [
    (1, "The cat sat on the mat and looked at the old dog by the door, again.", "a", 1),
    (2, "The cat sat on the mat and looked at the old dog by the door, again.", "a", 2),
    (2, "The cat sat on the mat and looked at the old dog by the door, again.", "a", 2),
    (3, None, "b", None),
    (4, "", "b", 4),
    (5, " \n\t ", None, 5),
    (6, LONG, "c", 6),
    (7, "One.", "c", 7),
    (None, "A text without an id, which is written in plain words.", None, None),
    (8, "Été à la plage; süße Früchte.\nEs una línea más \U0001f600 ퟿", "d", 8),
    (9, "!!! ??? ***", "d", 9),
    (10, "AAA BBB ccc ddd eee fff ggg hhh iii jjj kkk", "a", 10),
]
# Further columns named like those the operators use inside.
SCHEMA = "doc_id long, text string, source string, found long"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
