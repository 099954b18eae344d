"""Frame annotations to ego-relative windows and scene features.

Time is an integer frame number; a window is a run of kept frames. Everything is
keyed by scene and frame, and frame positions come from the distributed index,
so a scene that owns a third of all frames is cut like any other value range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import dense_index

# Fixed values of the windowing contract.
FRAME_STRIDE = 5                   # 10 Hz frames to a 0.5 s grid
WINDOW_STEPS, WINDOW_STRIDE = 12, 4
ANCHOR_STEP = 3                    # the 4th step of a window
MAX_DISTANCE, MAX_AGENTS = 60.0, 48
MAX_WINDOWS = 22                   # windows of a scene used by default
HALF_LENGTH, HALF_WIDTH = 2.4, 0.9
BOX_CLASSES = ("vehicle", "walker", "ego_vehicle")
COMMAND_SLOT = {1: 0, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}     # left, straight, right; else other
OTHER_SLOT, COMMAND_SLOTS = 3, 4
AGENT_CHANNELS = ("rel_x", "rel_y", "cos_psi", "sin_psi", "speed", "half_len", "half_wid",
                  "is_vehicle")
EGO_CHANNELS = ("rel_x", "rel_y", "cos_psi", "sin_psi", "speed", "is_future")
SD_FLOOR = 1e-9


def downsample(frames: DataFrame, lengths: DataFrame | None = None,
               every: int = FRAME_STRIDE) -> DataFrame:
    """Every n-th frame among the first nf files of a scene.

    Position is the rank of the file within its scene, not its number. lengths
    (scene, nf) caps the files of a scene; without it all are used. Frames marked
    in a column `bad` count for positions and the cap and are dropped afterwards.
    """
    placed = dense_index(frames.withColumnRenamed("frame", "_f"), "_f", "file_pos", ["scene"])
    if lengths is not None:
        placed = (placed.join(lengths.select("scene", "nf"), "scene")
                  .where(F.col("file_pos") < F.col("nf")).drop("nf"))
    if "bad" in frames.columns:
        placed = placed.where(~F.col("bad")).drop("bad")
    return placed.where(F.col("file_pos") % every == 0).withColumnRenamed("_f", "frame")


def explode_boxes(frames: DataFrame, keep: Sequence[str] = ("scene", "frame")) -> DataFrame:
    """One row per usable box: vehicle, walker or ego with a finite position."""
    box = frames.select(*keep, F.posexplode("boxes").alias("pos", "box"))
    x = F.get("box.location", F.lit(0))
    y = F.get("box.location", F.lit(1))

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    extent = F.col("box.extent")
    has_extent = extent.isNotNull() & (F.size(extent) > 0)
    rotation = F.col("box.rotation")
    return box.where(F.col("box.class").isin(*BOX_CLASSES) & finite(x) & finite(y)).select(
        *keep, "pos", F.col("box.class").alias("class"), F.col("box.id").alias("id"),
        x.alias("x"), y.alias("y"),
        F.when(rotation.isNotNull() & (F.size(rotation) > 2),
               F.radians(F.get(rotation, F.lit(2)))).otherwise(0.0).alias("yaw"),
        F.coalesce("box.speed", F.lit(0.0)).alias("speed"),
        F.when(has_extent, F.get(extent, F.lit(0))).otherwise(HALF_LENGTH).alias("half_len"),
        F.when(has_extent, F.get(extent, F.lit(1))).otherwise(HALF_WIDTH).alias("half_wid"),
        F.when(F.col("box.class") == "vehicle", 1.0).otherwise(0.0).alias("is_vehicle"))


_STATE = ("x", "y", "yaw", "speed", "half_len", "half_wid", "is_vehicle")


def last_agents(boxes: DataFrame) -> DataFrame:
    """Last record per agent id in a frame; first_pos keeps its first appearance."""
    agents = boxes.where((F.col("class") != "ego_vehicle") & F.col("id").isNotNull())
    return (agents.groupBy("scene", "frame", "id")
            .agg(F.max_by(F.struct(*_STATE), "pos").alias("last"), F.min("pos").alias("first_pos"))
            .select("scene", "frame", "id", "first_pos", "last.*"))


def last_ego(boxes: DataFrame) -> DataFrame:
    """Last ego record in a frame; frames without one have no row."""
    return (boxes.where(F.col("class") == "ego_vehicle").groupBy("scene", "frame")
            .agg(F.max_by(F.struct(*_STATE), "pos").alias("last"))
            .select("scene", "frame", *[F.col(f"last.{c}").alias(c) for c in _STATE]))


def kept_frames(ego: DataFrame) -> DataFrame:
    """Ego rows with their position `seq` among the kept frames of the scene and `n_kept`."""
    placed = dense_index(ego, "frame", "seq", ["scene"])
    n = ego.groupBy("scene").agg(F.count("*").alias("n_kept"))
    return placed.join(n, "scene")


def window_steps(kept: DataFrame) -> DataFrame:
    """(scene, widx, step, seq, frame): 12 steps every 4, starts with start + 12 < n.

    Each kept frame lists the windows it belongs to, so windows are made without
    joining a scene to itself.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - (WINDOW_STEPS - 1)) / WINDOW_STRIDE))
    last_start = F.floor((F.col("n_kept") - WINDOW_STEPS - 1) / WINDOW_STRIDE)
    last = F.least(F.floor(F.col("seq") / WINDOW_STRIDE), last_start)
    return (kept.where((F.col("n_kept") > WINDOW_STEPS) & (first <= last))
            .select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("widx"))
            .withColumn("step", (F.col("seq") - F.col("widx") * WINDOW_STRIDE).cast("int"))
            .drop("n_kept"))


def anchors(steps: DataFrame) -> DataFrame:
    """Ego pose at the anchor step of each window."""
    return steps.where(F.col("step") == ANCHOR_STEP).select(
        "scene", "widx", F.col("seq").alias("anchor_seq"), F.col("frame").alias("anchor_frame"),
        F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("yaw").alias("eyaw"))


def nearest_agents(anchor: DataFrame, agents: DataFrame, k: int = MAX_AGENTS,
                   within: float = MAX_DISTANCE) -> DataFrame:
    """(scene, widx, id, slot, dist): nearest agents present at the anchor frame."""
    at = anchor.join(agents.withColumnRenamed("frame", "anchor_frame"), ["scene", "anchor_frame"])
    dist = F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"))
    order = Window.partitionBy("scene", "widx").orderBy("dist", "first_pos")
    return (at.withColumn("dist", dist).where(F.col("dist") < within)
            .withColumn("slot", F.row_number().over(order).cast("bigint") - 1)
            .where(F.col("slot") < k)
            .select("scene", "widx", "id", "slot", "dist"))


def _relative(dx: Column, dy: Column, eyaw: Column) -> tuple[Column, Column]:
    c, s = F.cos(-eyaw), F.sin(-eyaw)
    return dx * c - dy * s, dx * s + dy * c


def window_agents(steps: DataFrame, anchor: DataFrame, near: DataFrame, agents: DataFrame,
                  fill: bool = True) -> DataFrame:
    """Agent channels per (scene, widx, slot, step), seen from the anchor pose.

    With fill, a step where the agent is absent is a row of zeros with mask false.
    """
    when = steps.select("scene", "widx", "step", "frame")
    slots = near.select("scene", "widx", "slot", "id").join(anchor, ["scene", "widx"])
    grid = slots.join(when, ["scene", "widx"])
    joined = grid.join(agents, ["scene", "frame", "id"], "left" if fill else "inner")
    rx, ry = _relative(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"), F.col("eyaw"))
    turn = F.col("yaw") - F.col("eyaw")
    values = (rx, ry, F.cos(turn), F.sin(turn), F.col("speed"), F.col("half_len"),
              F.col("half_wid"), F.col("is_vehicle"))
    return joined.select(
        "scene", "widx", "slot", "step", F.col("x").isNotNull().alias("mask"),
        *[F.coalesce(v, F.lit(0.0)).cast("float").alias(name)
          for name, v in zip(AGENT_CHANNELS, values)])


def window_ego(steps: DataFrame, anchor: DataFrame) -> DataFrame:
    """Ego channels per (scene, widx, step), seen from the anchor pose."""
    joined = steps.join(anchor, ["scene", "widx"])
    rx, ry = _relative(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"), F.col("eyaw"))
    turn = F.col("yaw") - F.col("eyaw")
    values = (rx, ry, F.cos(turn), F.sin(turn), F.col("speed"),
              F.when(F.col("step") > ANCHOR_STEP, 1.0).otherwise(0.0))
    return joined.select("scene", "widx", "step",
                         *[v.cast("float").alias(name) for name, v in zip(EGO_CHANNELS, values)])


def window_command(anchor: DataFrame, commands: DataFrame, command_index: str = "frame",
                   every: int = FRAME_STRIDE) -> DataFrame:
    """(scene, widx, slot, cmd): one-hot command at the anchor, index clamped to the end.

    command_index='frame' reads the command of the anchor's own frame;
    'sequence' reads at anchor position x 5, which ignores dropped frames.
    """
    if command_index not in ("frame", "sequence"):
        raise ValueError("command_index must be 'frame' or 'sequence'")
    n = commands.groupBy("scene").agg(F.count("*").alias("n_cmd"))
    at = (F.col("anchor_frame") if command_index == "frame"
          else F.col("anchor_seq") * F.lit(every))
    wanted = anchor.join(n, "scene").select(
        "scene", "widx", F.least(at.cast("int"), (F.col("n_cmd") - 1).cast("int")).alias("frame"))
    slot = F.lit(OTHER_SLOT)
    for value, where in COMMAND_SLOT.items():
        slot = F.when(F.col("cmd") == value, where).otherwise(slot)
    hot = F.array(*[F.when(F.col("slot") == k, 1.0).otherwise(0.0).cast("float")
                    for k in range(COMMAND_SLOTS)])
    return (wanted.join(commands, ["scene", "frame"]).withColumn("slot", slot)
            .select("scene", "widx", "slot", hot.alias("cmd")))


def pack_windows(window_agent: DataFrame, ego: DataFrame, command: DataFrame,
                 slots: int = MAX_AGENTS) -> DataFrame:
    """One row per window with padded arrays: agents, mask, ego, cmd.

    A window holds at most slots x 12 agent rows, so the arrays are bounded.
    """
    zero = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(AGENT_CHANNELS)),
                          WINDOW_STEPS)
    unseen = F.array_repeat(F.lit(False), WINDOW_STEPS)
    per_slot = window_agent.groupBy("scene", "widx", "slot").agg(F.sort_array(F.collect_list(
        F.struct("step", F.array(*AGENT_CHANNELS).alias("v"), "mask"))).alias("s"))
    agents = per_slot.groupBy("scene", "widx").agg(F.sort_array(F.collect_list(
        F.struct("slot", F.col("s.v").alias("v"), F.col("s.mask").alias("m")))).alias("a"))
    egos = ego.groupBy("scene", "widx").agg(F.sort_array(F.collect_list(
        F.struct("step", F.array(*EGO_CHANNELS).alias("v")))).alias("e"))
    rows = egos.join(command.select("scene", "widx", "cmd"), ["scene", "widx"], "left").join(
        agents, ["scene", "widx"], "left")
    have = F.coalesce(F.size("a"), F.lit(0))
    have = F.greatest(have, F.lit(0))

    def padded(name: str, pad: Column) -> Column:
        got = F.when(F.col("a").isNull(), F.slice(F.array(pad), 1, 0)).otherwise(
            F.col("a").getField(name))
        return F.concat(got, F.array_repeat(pad, (F.lit(slots) - have).cast("int")))

    return rows.select("scene", "widx", padded("v", zero).alias("agents"),
                       padded("m", unseen).alias("mask"),
                       F.col("e").getField("v").alias("ego"), "cmd")


def first_windows(windows: DataFrame, w: int = MAX_WINDOWS) -> DataFrame:
    """The first w windows of each scene; windows are numbered without gaps."""
    return windows.where(F.col("widx") < w)


def even_windows(windows: DataFrame, w: int = MAX_WINDOWS) -> DataFrame:
    """w windows spread over each scene: positions floor(k n / w)."""
    n = windows.groupBy("scene").agg((F.max("widx") + 1).alias("_n"))
    k = F.ceil(F.col("widx") * F.lit(w) / F.col("_n"))       # smallest k that reaches widx
    hit = (F.col("_n") <= w) | ((F.floor(k * F.col("_n") / w) == F.col("widx")) & (k < w))
    return windows.join(n, "scene").where(hit).drop("_n")


def scene_features(window_agent: DataFrame, ego: DataFrame) -> DataFrame:
    """Per scene: ego speed, nearest agent, agents per window, windows."""
    agent = window_agent.where(F.col("mask") & (F.col("step") == ANCHOR_STEP))
    near = (agent.groupBy("scene").agg(
        F.min(F.hypot("rel_x", "rel_y")).alias("nearest"), F.count("*").alias("_n")))
    drive = ego.groupBy("scene").agg(
        F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"),
        F.count_if(F.col("step") == ANCHOR_STEP).alias("n_windows"))
    return drive.join(near, "scene", "left").select(
        "scene", "mean_speed", "max_speed", F.coalesce("nearest", F.lit(MAX_DISTANCE))
        .alias("nearest"), (F.coalesce("_n", F.lit(0)) / F.col("n_windows")).alias("mean_agents"),
        "n_windows")


def build_windows(boxes: DataFrame, k: int = MAX_AGENTS) -> dict[str, DataFrame]:
    """All window tables of a box table (see explode_boxes)."""
    agents, ego = last_agents(boxes), last_ego(boxes)
    steps = window_steps(kept_frames(ego))
    anchor = anchors(steps)
    near = nearest_agents(anchor, agents, k)
    return {"steps": steps, "anchors": anchor, "near": near,
            "agents": window_agents(steps, anchor, near, agents),
            "ego": window_ego(steps, anchor)}
