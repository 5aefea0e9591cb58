"""SHA-256 of the canonical form of whole licence texts, as published and with a paragraph a line."""

from __future__ import annotations

# Digests by SPDX name; of the longer licences with and without what follows the terms,
# of BSD with the usual names of holders, item marks and titles.
DIGESTS = {
    "Apache-2.0": (
        "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a",
        "3c6e3f9cad6f84cbf916ef04197be970a16ed4bc5d81c0f27646e4a1f7f38073",
        "812077d8c127a9bbd42473cd95b6cfaab17a824888d268b39c1f5023a7e6a5bb",
        "b41b69f0dea0598ca720f95f7c676dc79782779377951993e5bdd566fec422f3",
        "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
        "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    ),
    "Artistic-1.0": (
        "687e166aefc4fff2545711af3d6844374ff13fb25aa48d3861a3b56361f815a3",
        "93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0",
    ),
    "BSD-2-Clause": (
        "18a4ded338bbc2e1519cd794de3c17e3d5fe9628e240824c584fecdebe777a72",
        "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2",
        "2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7",
        "2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071",
        "39bf1f2d26ae8c366dc83591039be7f0d61a26df3e0791f80c2e7dea787c89cb",
        "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
        "4b12427c919036fc08e3d3d6bda2d2d0fed58212d4c5dfc57237af4a66887098",
        "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374",
        "5904a2cdd50cd05deccbe19145dd59b025c76c105ec36996c8e575afb205f66e",
        "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9",
        "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2",
        "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221",
        "8ae7f39b91fd008473df65ac941dc23824f275d57df303341862f076ba676965",
        "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
        "a6731986a534ac065169099d7305e0d83238d16d2c0d245a5a694f24e8b50b17",
        "abd430d487b7185615c0aebfe4f3395d57025a8932dad292488331d74289f4e5",
        "b070fd5d70d88d2dc201bf62e27cd5c1a36261a7b51912e5e4f044a2081fc2be",
        "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893",
        "bdca3363615115dce56af9c4d7115244942d986d410f6cec864373f2c885f84c",
        "c6d211d50708a59b74a361d242474efeae606eb9aceff1d3a05a3f36f4e889f4",
        "cfeddb2ad80fb82a81b5855b5d90f2a78be79239418870aae827d82410acea52",
        "d22f05ce62f3495464764559287fd9eceb4d68b849486092c8bbd14e81e09701",
        "dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642",
    ),
    "BSD-3-Clause": (
        "024f507653b6d741cff2f778cf08f29b18ac25b0ac3c8fc9fd5747a6cf694c48",
        "025d35b51900b4d7c8c41f268a1bc42d2ff8e98352b31a84bfd1a3182069b0b3",
        "033277db679b3d4f47d218756716157e16923afce7d1363dd3ea9f564dd86142",
        "0a693a9b0f9f456ac1a8ead8338f14410fa65b203bbad63be901a84d32b36eaf",
        "0ac5819e2f0bafce5ad798ca177cdf6b5dae5ee3e618450c0108aa3f7768a458",
        "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d",
        "1006daeb1324c9ad53d0df375b702acbce2d142c9f26dffdb4999842f48ee2f4",
        "13bd4956c077751ad193b5da48b859c64ed6922c7c2b69a588be360696d979c1",
        "142666e76acd010e85adac3949429f5186cabe996fe4956e4d367280c60e49bc",
        "1a4e6cb6e2587871e155a11bac8b305cc8c1daecd6bb7582ee357ed9e04ec62a",
        "1c934c9ec4aa76c64e14faf35e503956b3f7410742b0f429ffd24c9337959201",
        "1e9eef4db1751b3ae8a4dcf0e099423200fc2acbba0f11dd8a9441b2bf87f686",
        "1ef477d3b94aaba2167a54e02bf9e6051049a43b4845b55cb535e47d6f232c6d",
        "22fdacb46c5e6785bd2beb15c508dce499474e89f6cc658d75e5ab54d7b83f37",
        "25944ff1e82949a76cc9647410ddc1920db62afb9ba24d60fda8caee6295686a",
        "26ceb0a978fd83d209cd22081d8636f2b41a1635ce06d61210c1380663ab7eca",
        "2862502b8c0b9e2898bddc193550da25efbe12dcc633cf5c250c8acd75d2fcfc",
        "2a2af4fe0a0c9e8dc0f8df538b0df789d036fb47c3c60b1f493cc8dbd0720505",
        "2e5339ae545d66b173026547c5e877452d653ad4ab88e0d435508536e943009b",
        "33512bc1af4d9489f7408d3510324a8001aabccd277956747a080461c97522cf",
        "3652253ded83dc9e7a4b83297e414fba2e0db34dcfe1f4bbf7865fbcc84537fc",
        "3e496620febfa9432d4a596472593c179b029f9f48091f4f36a0a03679437e05",
        "4317258576f7e0b439c9f302a40656ca5c4771a81a49e204b65571888e7675f3",
        "4423b927d48a99a6e57a3fb29eb26cd2d176c5cad10eabc6a36866553cc6159f",
        "496a88fb77f7cf55994de8bd2b87ac0e9302e2dc1b11f567dd0447f8f0648ab1",
        "4af3efd27cc12d2146661de254afc90bde9fc2c708eddbfe69013f2c8cf24654",
        "4d4c7991eec13c8481fd08902fee35e8a6cb959c727b7aa5dc0c4ce6bbb9c6a3",
        "4dca118fcf8557d8ebe826c91520df502fdc017fec0fed23de1a09626fe8b164",
        "4f45d4850adf3be95f931e0a5d165d07595f11b5ae5a8f0254ebff5520245230",
        "5112931d0912b35d46ee49f15e1854f6f26db48b1683933184025de1c54052c9",
        "52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45",
        "52a8f7b5a4e5a4bbf1a6338d139c576a70cea4f01a64468d1579ba3a160ca231",
        "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa",
        "549a0b4960f4ffdc99ff68cb9cd4c3e22cb7891b5fc166e37fbf5e344399dce2",
        "5779e3f243fbc352fd1b04796edd0a850516d8a07974dff1a52a9b2f8ec136e4",
        "5b8dfff2c255cd344d92384d50d14259b5dbe5556c177b29f75f9576b0bdc3b2",
        "5ea652cbf21e580b4d227088b9bbb3a81f8014fcd4173e6d7da7b6f25b02d6d9",
        "611b21fb42c767eb6d088caa1c4d9dcc7f28094bc96a021e03c1208cab8981ef",
        "64b77abcb194e334c8fa0375ac3a4e5e874f558ecb6145f801c69242c6e22b78",
        "6879a2e5a31cfbe41662378bd0e807b54603e40ba10bfbeb55484d803ae67da2",
        "69aeed1f9be56bdf8186d85d25eb116824ffd1a9f5d310a7bd3a512dc26c1a59",
        "6b6b8ced3018142cdae478baf6ea47dc84752a70242c6b07f9c2205cffc82e59",
        "6cded2d64ede823606e0ad912d43ef7cf641160926310fa31217c3749fa32aee",
        "6e5bc7d06b9485f41b9e2e272443a94351b113b594b4615a14a64b741fc6d298",
        "6e636cc21b1ef1a5a79ac9b4c43b18da62350e54cca2ed05b4bc31361d7a9eb3",
        "71cf08b8c05578254c14bb399fc5a7858151620fb4deaebb8570c6b11f37f3a3",
        "74c9b2e71fa8516fabb01694dea4765aabff1a3c2b5e49d1b73191eafe709873",
        "7668aff13b074ee8ff72fe4d1e7a5866b755b8fc00cd0239e4e80aec12f32127",
        "792b3af8541a8f2f25ab651c95bd43fbc4152ca5515682ac90519b8fda84655f",
        "7aeeeae04683ca2146c56bd853a6dc04ba697e70531fd43f1b6923042fd1d204",
        "7bf5713ca296b08ea88a5ab4dc815cb078bc97d56fec2034952bc7d8ba65b4dd",
        "7cbe4ac7ab1cab771da0fc4575498af1b507b928d451fd2e387abb49e42ca752",
        "83af1241b499a61f80b36be0878269abf27b53e1687d1f13c644dc7f0c28d996",
        "84586461c43d91cf850a92845a06a9ea720d60e2f7b15d68719f3aed94383ab9",
        "86bb951dfb42e3b4174f359f4fe9731f94379051cd2014427f4cead3f457475c",
        "8c43033e30638dbf655a64e3b9cb5ad496739e3265cd1173bf9de626f4c07b0d",
        "8e06f3eb8c471515579052a428e5ab2d0777573b150dcfaf3c8b86b61989c907",
        "8e6a00da3b41501414630318cd39ab4b24a7f05ff2efaef3b6ad87f3b1745747",
        "8e9464e1e5fed9c56b6a993c8f1362f398bd6b806e5b997aa4f97d459ffec04d",
        "907ca4d9e1b9f1f0223143275558eb7e180c2921a94eeb951ee099bef4515792",
        "912a849a580ad0b4d28ab20c2fdefbf7a94627e1fd15ca1ab09066682b5989f9",
        "93facae17cbb1a8c467683819001c40939dafdd0d006162da0ba18d04bafa3c5",
        "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f",
        "952fc26f86fba75aa81f368011daff42c58514bcc8c7ffb46056ab1ee61789c3",
        "9722c723779d44d611759bb0fd8a113b34bd46d725cf5bc3b672ad2bf58e5763",
        "99ec8da636fb9fb69a2467c7a095c05818c1f9b0ec7455fca9e1f0491ca90c5a",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "9b95e6b9046b171ce23146e7b8a5beb0beede2c854f304cee079a2b9eeeada77",
        "9bacbe2d740568810157a15fd2c76297a34413bb3b701a4339a78581af989fc2",
        "9d35da508bc9f8b6c079a39f033dc94a53c80ef10a0e9499c6cbf55882ee5d3d",
        "a06df82de55c78a283b2dd81105c51f24a3899ddd8e49a08a15b8e55885a36b2",
        "a1b219564f74c286b8e6d513ce628a398682d68f7ebee4316d742d704938f7dd",
        "a2ec481ad273e32b9116be38e2a471834cea10b21644709e6000a0341ee6c5b2",
        "a5a573db8b91209439e7e29d667630fcd8f9ad52e07b4125cbe5f995281ee214",
        "a63cc451f29828362d2e0e3a4a18de5397aa61a68bbdbedc1670d2a96771dc08",
        "a71f9eed552d590fc3fca7c2f91f4747179c9ebb4699af475c2c6b16b6c13f75",
        "a772d5818791ac44ca752b2f36a65bd691fb6827311afedbcb995bbfc44c149c",
        "aef0b068b885919450ca1c5e2fb5895f84639dcf1fb114e8d85d8a117b64985c",
        "afc81ee99a150bf9ad976d1b4b3bae3ec8fb30e82c7f9ec18d0048b070d2ebc8",
        "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9",
        "bd1529581253e2f061831cf3536252806dbb88139d01e2c46f954dbd99709aba",
        "bd7d910c4d2db198970b03aa0712c2453834c2245727445d4d1552208efbd9be",
        "bf77b4d79d9a881503471a749e561c53f521c67b57150830b8e4ec3f597d2bad",
        "c06fed52ae25eccda221ec029d67ef739319b7305392d922fd4fd000e0f439e9",
        "c0ecaef1daca3074620e93f6c9500c854900aedde63a274c500d64d6dfa36d76",
        "c1dd9261eb312a7ed0febbec348c0aad44c4ee87313f962599141e361cf7ae5b",
        "c20bd9e9a48d3165b5e500f6c32225194e99d15723430c8466d4b6390aeb0488",
        "c33eae53e070f94b59c8c34004133e03cf1a3a77c9986b1893cfbd2cfe8bf31d",
        "c3c37a3f2460d1e6b986324f6532d2e7c13d17671d91e5ccbf8b24d2caa2a3db",
        "c798eabda39eb5e1a65ddb779efcc085addc941172e1199a75fbc738fca7f189",
        "c9fea83e0f223aeb885389792c4539f99307ee7526f5e6202cebd0b53e027515",
        "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb",
        "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
        "cf9fea19504c6a22c8a429209096b0faf491f15645697459011a1d24ba61d15a",
        "d18a9cf83a168e0fb64a5d254735362137270d0a1260161abd56a7a28c5933cb",
        "d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590",
        "d4542b2c750ddc48ef799c19992beedb965469683f3ad3c4ecfee120fcf832c5",
        "d5b006b24bbe22125b707cc710f754c6f0ea8094b28c25faa7d1ca00cd780ebe",
        "d7891a0feb530b9047c063d392e60ffd9122b218cac2315b7a8e7d69ef66041f",
        "db7eb212132cf8b09c0ac1aebfd4d908745eceb2821e2b49f5e3ce424d3c9293",
        "dbdfde7fe53358e4d135fcf0485ffc425b2b94f13f57afa9728bfb29ad9c40e5",
        "dd2e7f8e2e6f9d43536863179e24ccb9f4e4df48c9b4e2cc9c5a019b7d774c40",
        "e0c917b4bc7d9f1f4f60c3aa49f4692a40b30d73c18e42dabdc76634f866e1b9",
        "e60143686f94bbff438ca8d1ec28b93f48dab068c458d943110c425586e89f38",
        "e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54",
        "e8915c8886dab830cc83aff7ccd3b0f523d245351c77027a6f5d0dd8d25b9f56",
        "e8a42affefb8967a820164e26156aed6d9bd512a6d3124b81268b4de552a250d",
        "eac1b63f081439ba1dd7ed03bfdcff40baddb0ec681a08f4f4259cb7187485e9",
        "ede829777fba47546f19fc32a5a7baa6a53a3a72bb2898d9360b6c6a2897cac6",
        "efcc9634f895cc2cafa5194dc3b983207f556a37e47427ba9f137cc05155e241",
        "f33cb11db92c77b61651eae1ae66347d4e4671a20ce127f31ec86ee1ce375b16",
        "f44f6fd563d8b7310498de671972282e74cec4f8ffea19461b095698399487ea",
        "f455d6e0f90f61de38d85f6a312ca47da45c799a616bc0d1d0813e081018bf4d",
        "f572d6b0df10a4e0c3e1bd6b50d24fc9beedf9cc09de6a67dfb7b3d13d0a85be",
        "f577a36a9646245f5bd78062cb88fe8e5443549393eaaa9925ca81fab0059653",
        "f6fd412b73c7bfe269aa7994c160e627a0b7375918afd4c9c1d007239571fb49",
        "f8ee7ddef53b6788d7fc73f0fac34c10faf8f5843fd1f7eb4d618f5130d8ebf3",
        "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af",
        "fa8eee52cef33c5c1c90a2d4abcc1967d0decd02989a8714e04c9bfeaca3cb29",
        "fbeba36b4c19ff4a85738ee084a1b651a5d6086b7158a6f2d8ef7fee909a6113",
    ),
    "BSL-1.0": (
        "4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85",
        "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GFDL-1.2": (
        "24984a15a79852251f41674cbf7d55bce4ae838d119f0d6948fa83a46585ab5d",
        "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
    ),
    "GFDL-1.3": (
        "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
        "bc882955885bd3e89f2ef05a0446e40db189a071714b8f691921a6f55721269c",
    ),
    "GPL-1.0": (
        "05aa44d3d0f6c6fdc97104d217cc505cc9408cf8dafb06932166b8be3e5bc522",
        "08289c1c73170392fe4b9595cbbda4589b37616fe27bc0baa39136c9f4605cd3",
        "1ce8bfafa2c1ac13aad02501899e0d9fed76f5295e9b1f396155dfaf443dccc3",
        "55a3cd4e1ccc3a36c7812f6c90fa48f7d012a7863738a15c1575c83f2114cb63",
        "671820f1cf530aee1a8bd21a88395e9334a3475f21cbebc85bed5d061fc68c92",
        "9a8834509f0ef3583f1f8c74c28c71b8e31e35f65f160b58ad89ab84cdf47825",
        "9eeb6e86dd1beeacbe4039d380ba86f0cdacec4feec4bed3e3be109dd4fd012e",
        "cf0caa24e3de326c7ede8efd053a2536cb075fb5a4353a66192fb831d89571e1",
    ),
    "GPL-2.0": (
        "0feefc595ca99aeadd99d5a92dc70ac205d3157aa0ffc39e76a9cf65904ae8b8",
        "2d4483968d75ba13ed749be6ee90456a730f1471bee7eaf9103e59fef39bb898",
        "3f35999274fbe5c0fe18427b3b0b3c4990efd1bb0210fded1b8b3fd80b31cdbc",
        "9c002599705d19cb35adce7c5f0679749e955080f4bf00a0d5785860b6e7c603",
        "a78dd76cffdc90efbe77abf8298cf2ac027cd731d2b437dde3e2b092c573f4ea",
        "fea8d92fb129dfd7e484d160d36968b087e01f1fb77f270edb72b1de48f93ae6",
    ),
    "GPL-3.0": (
        "3ea2268426fac33970d7b6b1b856e215b21541689e5781d53547b0f82fe40412",
        "5e62e8c7d1e5c885cc0d49bd4569266b1fea86b975864228e6641ddb2cde51d4",
        "ad403b7b90fabceb18a805fc4ee39c369f476181de7261ad5076d8f890ca7b20",
        "c3f755d9448edf51ea410b2a2b57dfce6c7e249023137a87fa2c77020c888d7d",
        "ca3bf68d7161986bacb4518ecbdab7a2b9e03bd4cb729b6d43681cade5122c2d",
        "d5540f29d95c5d940f91a18e79ffc629a1abd2f257a47f39642f31122ff6e103",
    ),
    "LGPL-2.0": (
        "20e5d0b8ec8611fe9e3e9775dde8188f3ec968ef4256ad296e5cb0c8be11feed",
        "2b79a8665e2b65d26fd1f0ef144e2c4f8c2693c090ad32f37d5dd447057dca55",
        "6894fd0bbbd234bc0fed7732965295abc7b9d8f4d17c1ebc02768281d99e4f89",
        "9397a0a9a20264a6dc4b88880ef771e4634e7e68439e9378d6e85d7b64046aea",
        "b4390c370da7afa7279c710867f85f70cc42d1da2757621d69e9c5ca299e67aa",
        "bb2bd9254260214e35f07260c03c3ade68bb07ca46a953802c3b73557860d828",
    ),
    "LGPL-2.1": (
        "3ccb6cf7a2bb03bc9d70bb2e3eb8191c0648fa4da95d29bfdbebbc66407bf114",
        "519e4e2dfe35399d801096c1abeaea99dc99b9a324664f90b8f3be3f3ea37d70",
        "8feb34e312d71708345858a74283b4d3d823b874f7df2a8c1a8f3453e2f4fd6c",
        "93dd2dc5ef62bf300b149b1d050d9eb898743fcc892d4cc2c90010624931e43b",
        "94ceb382276e8b324623118f8a27bdddbd0b4fd1d0519895c7e723279cf966c0",
        "dfb847aa043670c3d11a73240d4d9324a1587f0883c05d0a396b469a26448319",
    ),
    "LGPL-3.0": (
        "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8",
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
    "Unlicense": (
        "e004e218cb49cc5380ae88b74959546d5ffade35d8fa0f2d1fe2c87f91a33b89",
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
    ),
}
