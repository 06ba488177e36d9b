"""Binary files of a task in the shared store.

Tasks may run twice, so each attempt writes files of its own names and tells them in its
rows; only names in rows that Spark has committed count. Other files are left-overs.
"""

import uuid

from pyarrow import fs


def open_output(folder: str, name: str) -> tuple[str, object]:
    """(path, writable stream) of a new file that no other attempt writes."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    return f"{folder}/{file}", store.open_output_stream(f"{path}/{file}", compression=None)


def open_input(path: str):
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside, compression=None, buffer_size=1 << 20)


def write_bytes(folder: str, name: str, data: bytes) -> str:
    path, stream = open_output(folder, name)
    with stream:
        stream.write(data)
    return path


def read_bytes(path: str) -> bytes:
    with open_input(path) as stream:
        return stream.read()
