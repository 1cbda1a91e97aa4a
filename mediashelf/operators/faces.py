"""Incremental face clustering, distributed and exact.

The rule is sequential: faces of a user arrive file by file; each takes the person of the first of its five nearest
known faces that is similar enough and whose person is not already used in the same photo, else it founds a person.
What a face can see - the earlier faces - depends only on arrival order, so the five neighbours of every face come
from one blocked vector search. What remains is a graph with at most five edges per face; the people are its fixed
point, found by rounds that touch files, never a whole user:

1. every photo chooses, in detection order, from its faces' neighbours under the people assumed so far;
2. chosen edges are followed to their ends by pointer jumping, which gives the next assumption.

An unchanged choice means every choice was made under the people that the sequential run would have seen: edges only
lead to earlier faces, so by induction over arrival order the result equals the sequential one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as fv
from ..session import cut_and_count, cut_lineage
from .library import top_k
from .vector_search import search_blocks

FAR = 1 << 62


def normalize_faces(detections: DataFrame, min_size: int = 24, top: int = fv.FACES_PER_FILE) -> DataFrame:
    """Detections to faces: too small ones out, boxes relative to the image and clipped, best `top` per file.

    `detections`: user_id, file_id, det_id, x, y, w, h, score, image_width, image_height, scale (how much the image
    was shrunk before detection).
    """
    iw, ih = F.col("image_width"), F.col("image_height")
    big = F.least("w", "h") >= min_size * F.col("scale")
    zero, one = F.lit(0.0), F.lit(1.0)
    box = F.array(
        F.greatest(zero, F.col("x") / iw), F.greatest(zero, F.col("y") / ih),
        F.least(one, F.col("w") / iw), F.least(one, F.col("h") / ih),
    )
    faces = detections.filter(big).withColumn("bbox", F.transform(box, lambda v: F.round(v, 4)))
    faces = faces.withColumn("score", F.round("score", 3))
    return top_k(faces, ["user_id", "file_id"], [F.desc("score"), F.asc("det_id")], top)


def face_id(user: Column, file: Column, position: Column) -> Column:
    return F.sha2(F.concat_ws(":", user.cast("string"), file.cast("string"), position.cast("string")), 256)


def new_person_id(face: Column) -> Column:
    """A new person is named after its founding face, so a repeated run gives the same people."""
    return F.concat(F.lit("p-"), F.substring(F.sha2(face.cast("string"), 256), 1, 32))


def face_neighbours(new: DataFrame, known: DataFrame, threshold: float, topn: int) -> DataFrame:
    """(face_id, nbr, rank): the similar ones among each new face's `topn` nearest visible faces.

    `new` carries seq, its arrival number within the user. A known face of a file that is scanned again vanishes when
    the file's turn comes.
    """
    turn = new.groupBy("user_id", "file_id").agg(F.min("seq").alias("seen_to"))
    old = known.join(turn, ["user_id", "file_id"], "left").select(
        "user_id", "face_id", "embedding", F.lit(-1).cast("long").alias("seen_from"), F.coalesce("seen_to", F.lit(FAR)).alias("seen_to")
    )
    fresh = new.select("user_id", "face_id", "embedding", F.col("seq").alias("seen_from"), F.lit(FAR).alias("seen_to"))
    index = old.unionByName(fresh).withColumnRenamed("face_id", "nbr")
    # both sides may be large: wide query blocks keep the copies of the index few
    asked = new.select("user_id", "face_id", "embedding", "seq")
    found = search_blocks(asked, index, topn, ["user_id"], qid="face_id", xid="nbr", block_queries=8192)
    best = top_k(found, ["face_id"], [F.desc("cos"), F.asc("nbr")], topn, rank="rank")
    return best.filter(F.col("cos") >= threshold).select("face_id", "nbr", "rank")


def _choose(photo: Column) -> Column:
    """Fold a photo's faces (in detection order) into the chosen neighbour of each, null = a new person.

    The accumulator holds the people used so far; `options` of a face are its neighbours with their people.
    """
    empty = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast("array<struct<face_id:string,nbr:string,person:string>>").alias("out"),
    )

    def step(acc: Column, face: Column) -> Column:
        free = F.get(F.filter(face["options"], lambda o: ~F.array_contains(acc["used"], o["person"])), F.lit(0))
        person = F.coalesce(free["person"], new_person_id(F.substring(face["face_id"], 3, 200)))
        picked = F.struct(face["face_id"].alias("face_id"), free["nbr"].alias("nbr"), person.alias("person"))
        return F.struct(
            F.concat(acc["used"], F.array(person)).alias("used"), F.concat(acc["out"], F.array(picked)).alias("out")
        )

    return F.aggregate(photo, empty, step, lambda acc: acc["out"])


def follow(choice: DataFrame) -> DataFrame:
    """(face_id, person) at the end of each chain face_id -> nbr of new faces; chains end in a `person`.

    `choice`: face_id, nbr (the next new face, null at an end), person (set at an end). Pointer jumping: log2 of the
    longest chain rounds.
    """
    state, left = choice, 1
    while left:
        for _ in range(2):  # two jumps per written table: four times the reach
            ahead = state.select(F.col("face_id").alias("nbr"), F.col("nbr").alias("_nbr"), F.col("person").alias("_person"))
            state = state.join(ahead, "nbr", "left").select(
                "face_id", F.col("_nbr").alias("nbr"), F.coalesce("person", "_person").alias("person")
            )
        state, left = cut_and_count(state, F.col("person").isNull())
    return state.select("face_id", "person")


def assign_faces(
    new_faces: DataFrame, known_faces: DataFrame, threshold: float = fv.FACE_THRESHOLD, topn: int = fv.FACE_NEIGHBOURS
) -> DataFrame:
    """new_faces with person_id.

    `new_faces`: user_id, file_id, file_seq (arrival order of the file within the user), face_id, score, embedding;
    one scan per file. `known_faces`: user_id, file_id, face_id, person_id, embedding. Ids are compared as strings.
    A perfect duplicate has similarity 1 and matches (the work this follows scores it 0).
    """
    # new and known ids are told apart: a rescanned file brings its old face ids again
    order = [F.asc("file_seq"), F.desc("score"), F.asc("face_id")]
    in_photo = F.row_number().over(W.partitionBy("user_id", "file_id").orderBy(*order[1:]))
    raw = F.col("face_id")
    new = new_faces.withColumn("_det", in_photo).withColumn("_raw", raw)
    new = new.withColumn("face_id", F.concat(F.lit("n:"), raw.cast("string")))
    # (file, detection) orders a user without sorting one; the fullest photo says how far apart files must be
    most = new.agg(F.max("_det")).head()[0] or 0
    new = cut_lineage(new.withColumn("seq", F.col("file_seq").cast("long") * (most + 1) + F.col("_det")))
    known = known_faces.withColumns(
        {"face_id": F.concat(F.lit("k:"), raw.cast("string")), "person_id": F.col("person_id").cast("string")}
    )
    edges = face_neighbours(new, known, threshold, topn)
    persons = known.select(F.col("face_id").alias("nbr"), F.col("person_id").alias("_known")).join(
        edges.select("nbr").distinct(), "nbr", "left_semi"
    )
    edges = cut_lineage(edges.join(persons, "nbr", "left"))
    photos = new.select("user_id", "file_id", "face_id", "seq")
    # first assumption: everybody follows the nearest similar face
    nearest = edges.filter("rank = 1").select("face_id", F.when(F.col("_known").isNull(), F.col("nbr")).alias("nbr"), F.col("_known").alias("person"))
    choice = photos.select("face_id").join(nearest, "face_id", "left").withColumn(
        "person", F.when(F.col("nbr").isNull(), F.coalesce("person", new_person_id(F.substring("face_id", 3, 200)))).otherwise(F.col("person"))
    )
    choice = cut_lineage(choice)
    while True:
        people = follow(choice.select("face_id", "nbr", "person"))
        options = (
            edges.join(people.withColumnRenamed("face_id", "nbr"), "nbr", "left")
            .withColumn("person", F.coalesce("_known", "person"))
            .groupBy("face_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "nbr", "person", F.col("_known").isNotNull().alias("known")))).alias("options"))
        )
        none = F.array().cast("array<struct<rank:int,nbr:string,person:string,known:boolean>>")
        photo = (
            photos.join(options, "face_id", "left")
            .groupBy("user_id", "file_id")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "face_id", F.coalesce("options", none).alias("options")))).alias("photo"))
            .select(F.inline(_choose(F.col("photo"))))
        )
        ends = edges.filter("_known is not null").select("face_id", "nbr", F.lit(True).alias("_end"))
        chosen = photo.join(ends, ["face_id", "nbr"], "left").select(
            "face_id",
            F.when(F.col("_end").isNull(), F.col("nbr")).alias("nbr"),
            # an end keeps its person; a face that follows another new face takes whatever that one becomes
            F.when(F.col("nbr").isNull() | F.col("_end"), F.col("person")).alias("person"),
        )
        before = choice.select("face_id", F.col("nbr").alias("_nbr"), F.col("person").alias("_person"))
        same = F.col("nbr").eqNullSafe(F.col("_nbr")) & F.col("person").eqNullSafe(F.col("_person"))
        choice, changed = cut_and_count(chosen.join(before, "face_id").withColumn("_same", same), ~F.col("_same"))
        choice = choice.select("face_id", "nbr", "person")
        if not changed:
            out = new.drop("person_id").join(people.withColumnRenamed("person", "person_id"), "face_id")
            return out.drop("_det", "seq", "face_id").withColumnRenamed("_raw", "face_id")
