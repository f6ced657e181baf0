"""State machines shared by the batch scan and the streaming operators.

States are JSON-able. Every program lists the columns it reads, event time in microseconds first. ``memory`` is
the time in microseconds after which a state without new rows equals the initial one; ``due(state)`` the time after
which ``finish`` has something to say.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

SECOND = 1_000_000


class SynScan:
    """Distinct ports per target and distinct (target, port) pairs of one source; alerts empty both."""

    columns = ["us", "packet_id", "dst", "dst_port"]

    def __init__(self, window=10.0, ports=5, pairs=12, cooldown=30.0):
        self.window, self.ports, self.pairs = round(window * SECOND), ports, pairs
        self.cooldown = round(cooldown * SECOND)
        self.memory = max(self.window, self.cooldown)

    def initial(self):
        return {"events": [], "counts": {}, "pairs": 0, "alerted": {}}

    def _forget(self, state, us):
        events, counts = state["events"], state["counts"]
        old = 0
        while old < len(events) and events[old][0] < us - self.window:
            _, dst, port = events[old]
            ports = counts[dst]
            ports[port] -= 1
            if not ports[port]:
                del ports[port]
                state["pairs"] -= 1
                if not ports:
                    del counts[dst]
            old += 1
        if old:
            del events[:old]

    def _alert(self, state, key, us):
        last = state["alerted"].get(key)
        if last is not None and us - last <= self.cooldown:
            return False
        state["alerted"] = {k: t for k, t in state["alerted"].items() if us - t <= self.cooldown}
        state["alerted"][key] = us
        state["events"], state["counts"], state["pairs"] = [], {}, 0
        return True

    def step(self, state, row):
        us, packet_id, dst, port = row
        port = str(port)
        ports = state["counts"].setdefault(dst, {})
        if port not in ports:
            state["pairs"] += 1
        ports[port] = ports.get(port, 0) + 1
        state["events"].append([us, dst, port])
        self._forget(state, us)
        here, pairs = len(state["counts"].get(dst, {})), state["pairs"]
        if here >= self.ports and self._alert(state, "to " + dst, us):
            return [(us, packet_id, dst, "syn_scan_per_target", here)]
        if pairs >= self.pairs and self._alert(state, "distributed", us):
            return [(us, packet_id, "multiple_targets", "syn_scan_distributed", pairs)]
        return []

    def finish(self, state):
        return []


class UsernameEnumeration:
    """Distinct names since the last alert of one (client, service)."""

    columns = ["us", "packet_id", "username", "server"]

    def __init__(self, names=10):
        self.names = names

    def initial(self):
        return []

    def step(self, state, row):
        us, packet_id, username, server = row
        if username not in state:
            insort(state, username)
        if len(state) < self.names:
            return []
        found = len(state)
        state.clear()
        return [(us, packet_id, server, found)]

    def finish(self, state):
        return []


class Reassembly:
    """Fragments of one (source, target, datagram id), until the last one arrives or time runs out.

    Covered ranges that overlap are merged, ranges that only touch are not, and empty fragments are
    points, so "overlaps an earlier fragment" is two binary searches.
    """

    columns = ["us", "packet_id", "start", "size", "more"]

    def __init__(self, timeout=30.0, most=50, largest=65535):
        self.timeout, self.most, self.largest = round(timeout * SECOND), most, largest
        self.memory = self.timeout

    def due(self, state):
        return None if state["first"] is None else state["first"] + self.timeout

    def initial(self):
        return {"first": None, "first_id": None, "ranges": [], "points": [], "offsets": [], "count": 0, "total": 0}

    def _overlaps(self, state, start, end):
        ranges, points = state["ranges"], state["points"]
        at = bisect_left(ranges, [start, start])
        before = at > 0 and ranges[at - 1][1] > start and ranges[at - 1][0] < end
        inside = at < len(ranges) and ranges[at][0] < end and ranges[at][1] > start
        point = bisect_right(points, start)
        return before or inside or (point < len(points) and points[point] < end)

    def _cover(self, state, start, end):
        if start == end:
            insort(state["points"], start)
            return
        ranges = state["ranges"]
        at = bisect_left(ranges, [start, start])
        if at > 0 and ranges[at - 1][1] > start:
            at -= 1
        upto = at
        while upto < len(ranges) and ranges[upto][0] < end:
            start, end = min(start, ranges[upto][0]), max(end, ranges[upto][1])
            upto += 1
        ranges[at:upto] = [[start, end]]

    def _expire(self, state):
        out = [(state["first"] + self.timeout, state["first_id"], "timeout", 0)]
        state.update(self.initial())
        return out

    def step(self, state, row):
        us, packet_id, start, size, more = row
        out = []
        if state["first"] is not None and us - state["first"] > self.timeout:
            out += self._expire(state)
        if state["first"] is None:
            state["first"], state["first_id"] = us, packet_id
        state["count"] += 1
        state["total"] += size
        overlap = self._overlaps(state, start, start + size)
        self._cover(state, start, start + size)
        if overlap:
            return out + [(us, packet_id, "overlap", 0)]
        at = bisect_left(state["offsets"], start)
        if at < len(state["offsets"]) and state["offsets"][at] == start:
            out.append((us, packet_id, "duplicate", 0))
        else:
            state["offsets"].insert(at, start)
        if state["count"] > self.most:
            out.append((us, packet_id, "excessive", state["count"]))
        if state["total"] > self.largest:
            out.append((us, packet_id, "oversized", state["total"]))
        if not more:
            state.update(self.initial())
        return out

    def finish(self, state):
        return self._expire(state) if state["first"] is not None else []


class Handshake:
    """Three-way handshakes of one (client, server): SYN, SYN/ACK, then the first ACK completes it, once.

    An entry is forgotten ``pending`` seconds after its last SYN or SYN/ACK, or ``completed`` seconds once it is complete.
    """

    columns = ["us", "packet_id", "kind"]

    def __init__(self, pending, completed):
        self.pending, self.completed = round(pending * SECOND), round(completed * SECOND)
        self.memory = max(self.pending, self.completed)

    def initial(self):
        return {"last": None, "synack": False, "done": False}

    def step(self, state, row):
        us, packet_id, kind = row
        if state["last"] is not None and us - state["last"] > (self.completed if state["done"] else self.pending):
            state.update(self.initial())
        if kind == "S":
            state["last"] = us
        elif state["last"] is None:
            return []
        elif kind == "A":
            state["last"], state["synack"] = us, True
        elif state["synack"] and not state["done"]:
            state["last"], state["done"] = us, True
            return [(us, packet_id)]
        return []

    def finish(self, state):
        return []


class SlidingCount:
    """Rows of the key in ``[t - window, t]``, at every row."""

    columns = ["us", "packet_id"]

    def __init__(self, window):
        self.window = self.memory = round(window * SECOND)

    def initial(self):
        return []

    def step(self, state, row):
        us, packet_id = row
        state.append(us)
        del state[: bisect_left(state, us - self.window)]
        return [(us, packet_id, len(state))]

    def finish(self, state):
        return []


class SlidingDistinct:
    """Distinct values of ``column`` in ``[t - window, t]``, at every row; null values count as none."""

    def __init__(self, window, column="value"):
        self.window = self.memory = round(window * SECOND)
        self.columns = ["us", "packet_id", column]

    def initial(self):
        return {"rows": [], "held": {}}

    def step(self, state, row):
        us, packet_id, value = row
        rows, held = state["rows"], state["held"]
        if value is not None and value == value:
            name = str(value)
            rows.append([us, name])
            held[name] = held.get(name, 0) + 1
        old = 0
        while old < len(rows) and rows[old][0] < us - self.window:
            name = rows[old][1]
            held[name] -= 1
            if not held[name]:
                del held[name]
            old += 1
        del rows[:old]
        return [(us, packet_id, len(held))]

    def finish(self, state):
        return []


class FirstSeen:
    """Targets on a source's list. A packet that counts adds its target if it is not listed; only then those listed longer than the window go.

    So a target that is seen all the time leaves the list once after each window, and one that should have gone but was still
    listed is not added again by its own packet.
    """

    columns = ["us", "packet_id", "dst", "adds"]

    def __init__(self, window):
        self.window = self.memory = round(window * SECOND)

    def initial(self):
        return {"listed": []}

    def step(self, state, row):
        us, packet_id, dst, adds = row
        listed = state["listed"]
        if adds and all(name != dst for _, name in listed):
            listed.append([us, dst])
        old = 0
        while old < len(listed) and listed[old][0] < us - self.window:
            old += 1
        del listed[:old]
        return [(us, packet_id, len(listed), dst)]

    def finish(self, state):
        return []


class Branched:
    """Several programs in one: a key's rows name the one that follows them in their column ``branch``.

    The programs read ``us``, ``packet_id`` and, as far as they want it, ``value``, and put out rows of the same columns.
    """

    columns = ["us", "packet_id", "value", "branch"]

    def __init__(self, programs):
        self.programs = programs
        self.memory = max(p.memory for p in programs.values())

    def initial(self):
        return {}

    def step(self, state, row):
        program = self.programs[row[3]]
        if "of" not in state:
            state["of"] = program.initial()
        return program.step(state["of"], row[: len(program.columns)])

    def finish(self, state):
        return []


class Cooldown:
    """Rows far enough after the last kept one."""

    columns = ["us", "packet_id"]

    def __init__(self, seconds, strict):
        self.gap = self.memory = round(seconds * SECOND) + (1 if strict else 0)

    def initial(self):
        return {"last": None}

    def step(self, state, row):
        us, packet_id = row
        if state["last"] is not None and us - state["last"] < self.gap:
            return []
        state["last"] = us
        return [(us, packet_id)]

    def finish(self, state):
        return []


class CountThenReset:
    """Fires when ``threshold`` rows lie in the window, then starts over."""

    columns = ["us", "packet_id"]

    def __init__(self, window, threshold):
        self.window, self.threshold = round(window * SECOND), threshold
        self.memory = self.window

    def initial(self):
        return []

    def step(self, state, row):
        us, packet_id = row
        state.append(us)
        del state[: bisect_left(state, us - self.window)]
        if len(state) < self.threshold:
            return []
        found = len(state)
        state.clear()
        return [(us, packet_id, found)]

    def finish(self, state):
        return []
