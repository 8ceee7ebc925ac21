"""Tables: catalog, paging, search, fetched records, folders and files."""
