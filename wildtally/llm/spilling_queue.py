"""A priority queue of messages that goes to disk when it gets long."""

import heapq
import operator
import pickle
import tempfile

# Keys in memory, and messages of one block on disk.
HELD, BLOCK = 1 << 16, 1 << 10


class SpillingQueue:
    """Messages by key. Those of one key are combined (by ``+``); keys come out in ascending order.

    Sorted runs that do not fit are written to unnamed temporary files, which end with the task.
    """

    def __init__(self, held: int = HELD, combine=operator.add):
        self.held, self.combine = held, combine
        self.heap, self.waiting, self.runs, self.spilled = [], {}, [], 0

    def push(self, key, message):
        if key in self.waiting:
            self.waiting[key] = self.combine(self.waiting[key], message)
            return
        if len(self.waiting) >= self.held:
            self._spill()
        self.waiting[key] = message
        heapq.heappush(self.heap, key)

    def _spill(self):
        file = tempfile.TemporaryFile()
        keys = sorted(self.waiting)
        for start in range(0, len(keys), BLOCK):
            pickle.dump([(k, self.waiting[k]) for k in keys[start : start + BLOCK]], file)
        file.seek(0)
        run = self._read(file)
        first = next(run)
        heapq.heappush(self.runs, (first[0], self.spilled, first[1], run))
        self.spilled += 1
        self.heap, self.waiting = [], {}

    @staticmethod
    def _read(file):
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    def first(self):
        """The smallest key, or None."""
        keys = [q[0] if q is self.heap else q[0][0] for q in (self.heap, self.runs) if q]
        return min(keys) if keys else None

    def pop(self, key):
        """The message of the smallest key, which is ``key``; None if the smallest key is another one."""
        if self.first() != key:
            return None
        message = None
        if self.heap and self.heap[0] == key:
            heapq.heappop(self.heap)
            message = self.waiting.pop(key)
        while self.runs and self.runs[0][0] == key:
            _, tie, part, run = heapq.heappop(self.runs)
            message = part if message is None else self.combine(message, part)
            following = next(run, None)
            if following is not None:
                heapq.heappush(self.runs, (following[0], tie, following[1], run))
        return message
