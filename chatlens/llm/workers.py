"""Memory of the Python workers, which Spark keeps from one task to the next.

What a task has freed stays with the worker's allocators, so that every worker of an executor comes to hold the most
that any of its tasks needed, beside the JVM, also while it waits.
"""

import ctypes
import functools

import pyarrow as pa


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back():
    """Return what is freed to the system."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def thrifty(run):
    """The same function of a task's batches; when the task ends, however it does, what it freed is given back."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return task
