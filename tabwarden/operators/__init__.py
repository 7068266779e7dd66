"""One module per analysis family; every operator is DataFrame in, DataFrame out."""
